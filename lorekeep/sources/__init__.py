"""Scans, table schemas and sinks."""
