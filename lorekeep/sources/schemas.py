"""Schemas of the telemetry and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, INT, BOOL, TIME = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
MAP = T.MapType(STRING, STRING)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    """A name ending in ``?`` may be null."""
    return T.StructType([T.StructField(n.rstrip("?"), t, n.endswith("?")) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "user_interactions": _schema(
        ("event_id", STRING),
        ("session_id", STRING),
        ("conversation_id", STRING),
        ("turn_id", STRING),
        ("user_id?", STRING),
        ("interaction_type", STRING),
        ("event_type", STRING),
        ("timestamp", TIME),
        ("data?", MAP),
        ("metadata?", MAP),
        ("created_at", TIME),
    ),
    "sessions": _schema(
        ("session_id", STRING),
        ("user_id?", STRING),
        ("start_time", TIME),
        ("end_time?", TIME),
        ("duration_seconds?", DOUBLE),
        ("interaction_count", INT),
        ("last_activity?", TIME),
        ("is_active", BOOL),
        ("created_at", TIME),
        ("updated_at", TIME),
    ),
    "conversations": _schema(
        ("conversation_id", STRING),
        ("session_id", STRING),
        ("start_time", TIME),
        ("end_time?", TIME),
        ("duration_seconds?", DOUBLE),
        ("turn_count", INT),
        ("last_activity?", TIME),
        ("is_active", BOOL),
        ("created_at", TIME),
        ("updated_at", TIME),
    ),
    "turns": _schema(
        ("turn_id", STRING),
        ("conversation_id", STRING),
        ("session_id", STRING),
        ("start_time", TIME),
        ("end_time?", TIME),
        ("duration_seconds?", DOUBLE),
        ("query?", STRING),
        ("response?", STRING),
        ("response_time_seconds?", DOUBLE),
        ("query_length?", INT),
        ("response_length?", INT),
        ("is_complete", BOOL),
        ("created_at", TIME),
        ("updated_at", TIME),
    ),
    "evaluation_results": _schema(
        ("evaluation_id", STRING),
        ("session_id", STRING),
        ("conversation_id", STRING),
        ("turn_id", STRING),
        ("query", STRING),
        ("expected_answer", STRING),
        ("actual_answer", STRING),
        ("precision", DOUBLE),
        ("recall", DOUBLE),
        ("accuracy", DOUBLE),
        ("f1_score", DOUBLE),
        ("semantic_similarity", DOUBLE),
        ("answer_quality_score", DOUBLE),
        ("response_time_seconds", DOUBLE),
        ("num_retrieved_docs", INT),
        ("num_relevant_docs", INT),
        ("avg_relevance_score", DOUBLE),
        ("evaluation_timestamp", TIME),
        ("created_at", TIME),
    ),
    "performance_metrics": _schema(
        ("metric_id", STRING),
        ("session_id", STRING),
        ("conversation_id", STRING),
        ("turn_id", STRING),
        ("metric_name", STRING),
        ("metric_value", DOUBLE),
        ("metric_unit?", STRING),
        ("metric_category?", STRING),
        ("metadata?", MAP),
        ("timestamp", TIME),
        ("created_at", TIME),
    ),
}

# Defaults of fields a row may leave out.
_IDS = dict.fromkeys(["evaluation_id", "metric_id", "session_id", "conversation_id", "turn_id"], "default")
_COUNTS = {"num_retrieved_docs": 0, "num_relevant_docs": 0, "avg_relevance_score": 0.0}
_EMPTY_MAPS = ["data", "metadata"]
_NOW = ["created_at", "updated_at", "evaluation_timestamp"]
DEFAULTED = {
    "user_interactions": {},
    "sessions": {},
    "conversations": {},
    "turns": {},
    "evaluation_results": {**_IDS, **_COUNTS},
    "performance_metrics": _IDS,
}


def required(table: str) -> list[str]:
    """Columns that a row of a table must bring along."""
    given = {*DEFAULTED[table], *_EMPTY_MAPS, *_NOW}
    return [f.name for f in SCHEMAS[table].fields if not f.nullable and f.name not in given]


def conform(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the columns, types and defaults of a table. A null in a required
    column without a default is an error."""
    defaults = DEFAULTED[table]
    given = set(rows.columns)

    def column(field: T.StructField) -> Column:
        name, wanted = field.name, field.dataType
        value = F.col(name).cast(wanted) if name in given else F.lit(None).cast(wanted)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(wanted))
        elif name in _EMPTY_MAPS:
            value = F.coalesce(value, F.create_map().cast(wanted))
        elif name in _NOW or (name == "timestamp" and table == "performance_metrics"):
            value = F.coalesce(value, F.current_timestamp())
        elif not field.nullable:
            if name not in given:
                raise ValueError(f"{table} needs a column {name}")
            value = F.coalesce(value, F.raise_error(F.lit(f"{table}.{name} is null")).cast(wanted))
        return value.alias(name)

    return rows.select([column(f) for f in SCHEMAS[table].fields])
