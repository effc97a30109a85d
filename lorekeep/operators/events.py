"""Telemetry events: one envelope, one payload per kind."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import iso_timestamp, stable_id, word_count

# Interaction types and event types.
INTERACTION_TYPES = [
    "query",
    "response",
    "click",
    "hover",
    "scroll",
    "copy",
    "session_start",
    "session_end",
    "conversation_start",
    "conversation_end",
    "turn_start",
    "turn_end",
    "abandonment",
    "follow_up",
]
EVENT_TYPES = ["user_interaction", "system_event", "performance_metric", "error_event"]
# Kinds that count as activity of a session.
ACTIVITY = ["query", "click", "scroll", "copy", "follow_up"]

ENVELOPE = ["session_id", "conversation_id", "turn_id", "user_id", "timestamp"]
ROW = ["event_id", *ENVELOPE[:4], "interaction_type", "event_type", "timestamp", "data", "metadata"]


@dataclass(frozen=True)
class Kind:
    """How one kind of event is stored and which payload it takes from its row."""

    interaction_type: str
    payload: tuple[str, ...]
    event_type: str = "user_interaction"
    derived: dict[str, object] = field(default_factory=dict)


# Payload keys per kind, and the types some kinds are stored under.
KINDS: dict[str, Kind] = {
    "query": Kind(
        "query",
        ("query",),
        derived={"query_length": lambda: F.length("query"), "word_count": lambda: word_count("query")},
    ),
    "response": Kind(
        "response",
        ("response", "response_time"),
        "system_event",
        {"response_length": lambda: F.length("response"), "word_count": lambda: word_count("response")},
    ),
    "click": Kind(
        "click",
        ("element",),
        derived={"position": lambda: F.to_json(F.struct("x", "y")), "click_type": lambda: F.lit("left_click")},
    ),
    "hover": Kind("hover", ("element", "duration")),
    "scroll": Kind("scroll", ("scroll_depth", "scroll_direction")),
    "copy": Kind("copy", ("copied_text", "source_element"), derived={"copied_length": lambda: F.length("copied_text")}),
    # Dwell time is stored as a hover; the payload key tells them apart.
    "dwell": Kind("hover", ("element", "dwell_time")),
    "abandonment": Kind("abandonment", ("abandonment_type",)),
    "follow_up": Kind("follow_up", ("follow_up_type",)),
    # A performance metric is stored as a response.
    "performance": Kind("response", ("metric_name", "metric_value"), "performance_metric"),
}


def payload(entries: dict[str, Column]) -> Column:
    """A string map of the given entries."""
    return F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), v.cast("string"))])


def make_events(rows: DataFrame, kind: str) -> DataFrame:
    """Events of one kind from rows that have the envelope and the kind's payload
    columns, and optionally ``metadata`` and a distinguishing ``source_id``."""
    k = KINDS[kind]
    entries = {name: F.col(name) for name in k.payload} | {name: make() for name, make in k.derived.items()}
    metadata = F.col("metadata") if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    source = [F.col("source_id")] if "source_id" in rows.columns else []
    return rows.select(
        stable_id(F.lit(kind), "session_id", "conversation_id", "turn_id", F.unix_micros("timestamp"), *source).alias(
            "event_id"
        ),
        *ENVELOPE[:4],
        F.lit(k.interaction_type).alias("interaction_type"),
        F.lit(k.event_type).alias("event_type"),
        "timestamp",
        payload(entries).alias("data"),
        metadata.alias("metadata"),
    )


def valid_types(events: DataFrame) -> DataFrame:
    """Events of a known interaction and event type."""
    return events.filter(F.col("interaction_type").isin(INTERACTION_TYPES) & F.col("event_type").isin(EVENT_TYPES))


def flatten(events: DataFrame) -> DataFrame:
    """The envelope as plain values, with an ISO time string."""
    return events.withColumn("timestamp", iso_timestamp("timestamp"))


def payload_json(events: DataFrame) -> DataFrame:
    """Payloads as JSON text."""
    return events.withColumns({"data": F.to_json("data"), "metadata": F.to_json("metadata")})


def answer_events(answers: DataFrame) -> DataFrame:
    """Three events per answered question: query, response and its response time.

    ``answers`` has the envelope, ``query``, ``response`` and ``response_time``; one
    pass over it fans out, instead of a scan per kind.
    """
    empty = F.create_map().cast("map<string,string>")

    def event(kind: str, entries: dict[str, Column]) -> Column:
        k = KINDS[kind]
        return F.struct(
            stable_id(F.lit(kind), "session_id", "conversation_id", "turn_id", F.unix_micros("timestamp")).alias("event_id"),
            F.lit(k.interaction_type).alias("interaction_type"),
            F.lit(k.event_type).alias("event_type"),
            payload(entries).alias("data"),
            empty.alias("metadata"),
        )

    def given(kind: str) -> dict[str, Column]:
        k = KINDS[kind]
        return {name: F.col(name) for name in k.payload} | {name: make() for name, make in k.derived.items()}

    three = F.array(
        event("query", given("query")),
        event("response", given("response")),
        event("performance", {"metric_name": F.lit("response_time"), "metric_value": F.col("response_time")}),
    )
    return answers.select(*ENVELOPE, F.inline(three)).select(*ROW)
