"""Comparison of registered queries with their SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", round(v, 6) + 0.0)
    return v


def difference(spark_rows, spark_columns, con, sql: str) -> str | None:
    """What differs, or None."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} against {sorted(columns)}"
    order = sorted(columns)
    theirs = Counter(tuple(_plain(v) for v in _pick(row, columns, order)) for row in result.fetchall())
    ours = Counter(tuple(_plain(v) for v in _pick(row, spark_columns, order)) for row in spark_rows)
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; {order}; "
        f"{sum(extra.values())} only here, e.g. {str(next(iter(extra), None))[:600]}; "
        f"{sum(missing.values())} only there, e.g. {str(next(iter(missing), None))[:600]}"
    )


def _pick(row, columns, order):
    at = {c: n for n, c in enumerate(columns)}
    return [row[at[c]] for c in order]
