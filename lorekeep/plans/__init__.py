"""Registered queries: operators composed over the given tables."""
