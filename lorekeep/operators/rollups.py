"""Sessions, conversations and turns from events.

An event has the envelope, ``interaction_type`` and ``event_type``; lifecycle kinds
(``session_start`` … ``turn_end``) are rows like any other. Every roll-up is one
aggregation of counts, minima and maxima, so a session that holds a third of all events
is reduced within each task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import seconds_between
from lorekeep.operators.events import ACTIVITY


def _at(kind: str) -> Column:
    return F.when(F.col("interaction_type") == kind, F.col("timestamp"))


def _lifetime(level: str) -> list[Column]:
    """Start: the first start event, else the first event. End: the first end event."""
    active = F.col("interaction_type").isin(ACTIVITY)
    return [
        F.coalesce(F.min(_at(f"{level}_start")), F.min("timestamp")).alias("start_time"),
        F.min(_at(f"{level}_end")).alias("end_time"),
        F.max(F.when(active, F.col("timestamp"))).alias("_active"),
    ]


def _finish(level: str) -> dict[str, Column]:
    return {
        "duration_seconds": seconds_between("start_time", "end_time"),
        "last_activity": F.coalesce("_active", "start_time"),
        "is_active": F.col("end_time").isNull(),
    }


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session. ``interaction_count`` counts activity kinds only."""
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.max("user_id").alias("user_id"),
            *_lifetime("session"),
            F.count_if(F.col("interaction_type").isin(ACTIVITY)).cast("int").alias("interaction_count"),
        )
        .withColumns(_finish("session"))
        .select(
            "session_id",
            "user_id",
            "start_time",
            "end_time",
            "duration_seconds",
            "interaction_count",
            "last_activity",
            "is_active",
        )
    )


def conversation_rollup(events: DataFrame) -> DataFrame:
    """One row per conversation. ``turn_count`` counts turns started, which is activity
    of the conversation as well."""
    turns = F.max(_at("turn_start"))
    return (
        events.filter(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id")
        .agg(
            F.max("session_id").alias("session_id"),
            *_lifetime("conversation"),
            turns.alias("_turn"),
            F.count_if(F.col("interaction_type") == "turn_start").cast("int").alias("turn_count"),
        )
        .withColumn("_active", F.greatest("_active", "_turn"))
        .withColumns(_finish("conversation"))
        .select(
            "conversation_id",
            "session_id",
            "start_time",
            "end_time",
            "duration_seconds",
            "turn_count",
            "last_activity",
            "is_active",
        )
    )


def turn_rollup(events: DataFrame) -> DataFrame:
    """One row per turn with its first question and first answer."""
    kind, system = F.col("interaction_type"), F.col("event_type") == "system_event"
    first = lambda value, cond: F.min(F.when(cond, F.struct("timestamp", value.alias("v"))))["v"]
    data = lambda key: F.try_element_at("data", F.lit(key))
    answer = (kind == "response") & system
    return (
        events.filter(F.col("turn_id").isNotNull())
        .groupBy("turn_id")
        .agg(
            F.max("conversation_id").alias("conversation_id"),
            F.max("session_id").alias("session_id"),
            *_lifetime("turn"),
            first(data("query"), kind == "query").alias("query"),
            first(data("response"), answer).alias("response"),
            first(data("response_time"), answer).cast("double").alias("response_time_seconds"),
        )
        .withColumns(_finish("turn"))
        .select(
            "turn_id",
            "conversation_id",
            "session_id",
            "start_time",
            "end_time",
            "duration_seconds",
            "query",
            "response",
            "response_time_seconds",
            F.length("query").alias("query_length"),
            F.length("response").alias("response_length"),
            (~F.col("is_active")).alias("is_complete"),
        )
    )


def turn_pairs(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, query, response``: a user message and the assistant message
    right after it. Turns of a conversation are numbered without gaps, so the next one
    is found by an equi-join on both columns, however long a conversation is."""
    asked = messages.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answered = messages.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])
