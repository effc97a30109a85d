"""Live sessions, conversations and turns.

A key's events fold into one row of state, which the end event emits and drops. Only a
key that was started can end: an end without a start, or a second end, gives nothing.
A key without an end event would stay for ever, so an idle time-out can close it.
Times are microseconds since the epoch, so that state holds plain numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lorekeep.functions.text import seconds_between
from lorekeep.operators.events import ACTIVITY
from lorekeep.session import stream_settings

# What is known of a key. The state keeps it as JSON, which costs a fraction of a row of columns.
NAMES = ["parent", "user_id", "start", "active", "last", "n", "query", "query_at", "response", "response_time", "response_at"]
STATE = T.StructType([T.StructField("folded", T.StringType())])

OUTPUT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("active", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("timed_out", T.BooleanType()),
    ]
)

# Keys of the state; what is due at a time, and the keys that are.
KEY = T.StructType([T.StructField("key", T.StringType())])
DUE = T.StructType([T.StructField("due", T.LongType())])
KEYS = T.StructType([T.StructField("keys", T.ArrayType(T.StringType()))])

# Keys are folded in so many buckets.
BUCKETS = 8192

# Per level: key, parent and the kind whose events are counted (None: activity).
LEVELS = {
    "session": ("session_id", None, None),
    "conversation": ("conversation_id", "session_id", "turn_start"),
    "turn": ("turn_id", "conversation_id", None),
}


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


class Lifecycle(StatefulProcessor):
    """Folds the events of a key, one after another, into one row of state.

    Spark calls it for a bucket of keys, since a call, its state handle and the batch of rows it
    gives cost more than a hundred times the folding of an event. State stays a row a key: a
    micro-batch reads and writes the rows of its own keys, however many a bucket holds.
    """

    def __init__(self, idle_seconds: int | None) -> None:
        self._idle_ms = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getMapState("state", KEY, STATE)
        self._due = None if self._idle_ms is None else handle.getMapState("due", DUE, KEYS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen: dict[str, list[dict]] = {}
        for row in rows:
            step = NOTHING | json.loads(row["step"])
            seen.setdefault(step["key"], []).append(step)
        # A bucket without state, as each is at first, need not be asked for every key.
        some, due = self._state.exists(), {}
        for name, steps in seen.items():
            known = self._state.getValue((name,)) if some else None
            state = json.loads(known[0]) if known else None
            end, live = None, known is not None
            for step in steps:
                end = _least(end, step["ended"])
                live = live or step["live"] > 0
                state = self._fold(state, step)
            if not live:
                continue
            if end is not None and state["start"] is not None:
                if known:
                    self._state.removeKey((name,))
                yield self._row(name, state, end, False)
                continue
            self._state.updateValue((name,), (json.dumps(state),))
            if self._idle_ms is not None:
                due.setdefault(self._expiry(state), []).append(name)
        for at, names in due.items():
            before = self._due.getValue((at,))
            if not before:
                self._handle.registerTimer(at)
            self._due.updateValue((at,), (sorted({*names, *(before[0] if before else [])}),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = self._due.getValue((at,))
        for name in due[0] if due else []:
            known = self._state.getValue((name,))
            state = json.loads(known[0]) if known else None
            # A key that ended meanwhile is gone, and one that went on is due later.
            if state is None or self._expiry(state) != at:
                continue
            self._state.removeKey((name,))
            if state["start"] is not None:
                yield self._row(name, state, self._active(state), True)
        if due:
            self._due.removeKey((at,))

    def _expiry(self, state: dict) -> int:
        return state["last"] // 1000 + self._idle_ms

    @staticmethod
    def _fold(state: dict | None, row: dict) -> dict:
        s = state or dict.fromkeys(NAMES) | {"n": 0}
        s["parent"] = _most(s["parent"], row["parent"])
        s["user_id"] = _most(s["user_id"], row["user_id"])
        s["start"] = _least(s["start"], row["started"])
        s["last"] = _most(s["last"], row["seen"])
        s["active"] = _most(s["active"], row["active"])
        s["n"] += row["n"]
        for text in ("query", "response"):
            told, at = row[text], row[f"{text}_at"]
            if told is not None and (s[text] is None or (at, told) < (s[f"{text}_at"], s[text])):
                s[text], s[f"{text}_at"] = told, at
                if text == "response":
                    seconds = float(row["response_time"])
                    s["response_time"] = None if math.isnan(seconds) else seconds
        return s

    @staticmethod
    def _active(state: dict) -> int:
        return state["start"] if state["active"] is None else state["active"]

    def _row(self, key: str, state: dict, end: int, timed_out: bool) -> Row:
        return Row(
            key=key,
            parent=state["parent"],
            user_id=state["user_id"],
            start=state["start"],
            end=end,
            active=self._active(state),
            n=state["n"],
            query=state["query"],
            response=state["response"],
            response_time=state["response_time"],
            timed_out=timed_out,
        )


def _steps(events: DataFrame, level: str) -> DataFrame:
    """What each event does to the state of its key."""
    key, parent, counted = LEVELS[level]
    kind, at = F.col("interaction_type"), F.unix_micros("timestamp")
    activity = kind.isin(ACTIVITY)
    active = activity if counted is None else activity | (kind == counted)
    count = activity if counted is None else kind == counted
    data = lambda k: F.try_element_at("data", F.lit(k))
    asked = F.lit(level == "turn") & (kind == "query") & data("query").isNotNull()
    answered = F.lit(level == "turn") & (kind == "response") & (F.col("event_type") == "system_event")
    answered &= data("response").isNotNull()
    return events.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        (F.col(parent) if parent else F.lit(None).cast("string")).alias("parent"),
        "user_id",
        at.alias("seen"),
        F.when(kind == f"{level}_start", at).alias("started"),
        F.when(kind == f"{level}_end", at).alias("ended"),
        F.when(active, at).alias("active"),
        F.when(count, 1).otherwise(0).cast("long").alias("n"),
        F.when(kind == f"{level}_end", 0).otherwise(1).cast("long").alias("live"),
        F.when(asked, data("query")).alias("query"),
        F.when(asked, at).alias("query_at"),
        F.when(answered, data("response")).alias("response"),
        F.when(answered, at).alias("response_at"),
        # No number: first() below must not skip to the time of a later answer.
        F.when(answered, F.coalesce(data("response_time").cast("double"), F.lit(float("nan")))).alias("response_time"),
    )


# How the steps of a key combine into one.
COMBINE = {
    "parent": "max",
    "user_id": "max",
    "seen": "max",
    "started": "min",
    "ended": "min",
    "active": "max",
    "n": "sum",
    "live": "sum",
    "query": "first",
    "query_at": "first",
    "response": "first",
    "response_at": "first",
    "response_time": "first",
}

# A step of which nothing is known: JSON leaves out what is null.
NOTHING = dict.fromkeys(["key", *COMBINE])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One step per key and batch, before the shuffle: a key that has a third of all
    events sends one row per batch to its state. In the order below the first question
    and the first answer of a key are those the state keeps."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("seen", "ascending"), ("query", "ascending"), ("response", "ascending")])
        done = rows.group_by("key", use_threads=False).aggregate(list(COMBINE.items()))
        done = done.rename_columns([c.removesuffix(f"_{COMBINE.get(c.rpartition('_')[0], '')}") for c in done.column_names])
        yield from done.select(batch.schema.names).cast(batch.schema).to_batches()


def lifecycle_stream(
    events: DataFrame, level: str, *, idle_seconds: int | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """A stream of closed sessions, conversations or turns."""
    steps = _steps(events, level)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    # One text for all that Python reads of a step, as it gets rows cell by cell.
    combined = steps.mapInArrow(_combine, steps.schema).select(
        bucket.alias("bucket"), F.timestamp_micros("seen").alias("at"), F.to_json(F.struct(*steps.columns)).alias("step")
    )
    closed = combined.withWatermark("at", delay).groupBy("bucket").transformWithState(
        Lifecycle(idle_seconds), OUTPUT, "Append", "EventTime" if idle_seconds is not None else "None"
    )
    start, end, active = (F.timestamp_micros(c) for c in ("start", "end", "active"))
    key, parent, _ = LEVELS[level]
    common = [
        start.alias("start_time"),
        end.alias("end_time"),
        seconds_between(start, end).alias("duration_seconds"),
        active.alias("last_activity"),
        F.lit(False).alias("is_active"),
        "timed_out",
    ]
    if level == "session":
        return closed.select(F.col("key").alias(key), "user_id", F.col("n").cast("int").alias("interaction_count"), *common)
    if level == "conversation":
        return closed.select(
            F.col("key").alias(key), F.col("parent").alias(parent), F.col("n").cast("int").alias("turn_count"), *common
        )
    return closed.select(
        F.col("key").alias(key),
        F.col("parent").alias(parent),
        "query",
        "response",
        F.col("response_time").alias("response_time_seconds"),
        F.length("query").alias("query_length"),
        F.length("response").alias("response_length"),
        (~F.col("timed_out")).alias("is_complete"),
        *common,
    )


def start_lifecycle(closed: DataFrame, target: str, checkpoint: str, *, drain: bool = False) -> StreamingQuery:
    """Append closed rows to Parquet files below ``target``."""
    writer = (
        closed.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")
    with stream_settings(closed.sparkSession):
        return writer.start()
