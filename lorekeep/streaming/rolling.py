"""Roll-ups of sessions, conversations and turns that take events however late they come.

A micro-batch is reduced to one partial roll-up a key: minima, maxima and counts, which merge in
any order. The partial rows of keys that are still open are the state. A batch's rows are merged
with them and, where a key was closed before, with the row that it was closed with, which gives a
correction: the roll-up with the greater version. So the table holds at any time what one
aggregation of all events so far would give.

A key closes with its end event, or once the latest event of all keys is ``idle_seconds`` later
than its own last one. Closed keys leave the state; events that come later open them again or
correct them, and nothing is dropped for its age.

All work is aggregation and joins of whole batches, no call per key. Below the target:
``closed/version=v/bucket=b`` has keys closed or corrected by version v, ``open/version=v`` the
state, ``progress/version=v`` what is committed, written last. A batch that failed half-way is
written anew under the same version, and one that is committed is not folded again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.functions.text import seconds_between
from lorekeep.operators.events import ACTIVITY
from lorekeep.session import apart, cut_lineage

BUCKETS = 64
# Versions of closed rows that are kept apart before they become one.
COMPACT_EVERY = 32

# Per level: key, and the columns that it takes along.
LEVELS = {
    "session": ("session_id", ["user_id"]),
    "conversation": ("conversation_id", ["session_id"]),
    "turn": ("turn_id", ["conversation_id", "session_id"]),
}
TEXTS = ["query", "response", "seconds"]


def partials(events: DataFrame, level: str) -> DataFrame:
    """One mergeable row a key."""
    key, carried = LEVELS[level]
    kind = F.col("interaction_type")
    at = lambda cond: F.when(cond, F.col("timestamp"))
    data = lambda name: F.try_element_at("data", F.lit(name))
    active, counted = kind.isin(ACTIVITY), kind.isin(ACTIVITY)
    if level == "conversation":
        active, counted = active | (kind == "turn_start"), kind == "turn_start"
    answer = (kind == "response") & (F.col("event_type") == "system_event")
    said = {"query": (kind == "query", data("query")), "response": (answer, data("response")), "seconds": (answer, data("response_time"))}
    first = [F.min(F.when(cond, F.struct("timestamp", value.alias("v")))).alias(name) for name, (cond, value) in said.items()]
    return (
        events.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            *(F.max(c).alias(c) for c in carried),
            F.min(at(kind == f"{level}_start")).alias("started"),
            F.min("timestamp").alias("first"),
            F.min(at(kind == f"{level}_end")).alias("ended"),
            F.max(at(active)).alias("active"),
            F.max("timestamp").alias("seen"),
            F.count_if(counted).alias("n"),
            *first,
        )
    )


def merged(rows: DataFrame, level: str) -> DataFrame:
    """Partial rows of a key as one."""
    greatest = [*LEVELS[level][1], "active", "seen"]
    least = ["started", "first", "ended", *TEXTS]
    return rows.groupBy("key").agg(*(F.max(c).alias(c) for c in greatest), *(F.min(c).alias(c) for c in least), F.sum("n").alias("n"))


def finished(rows: DataFrame, level: str) -> DataFrame:
    """Roll-ups from partial rows with ``timed_out``, the columns of the batch roll-ups first.
    What timed out ends with its last activity."""
    key, carried = LEVELS[level]
    start = F.coalesce("started", "first")
    rows = rows.withColumns({"start_time": start, "last_activity": F.coalesce("active", start)})
    rows = rows.withColumn("end_time", F.when(F.col("timed_out"), F.col("last_activity")).otherwise(F.col("ended")))
    times = ["start_time", "end_time", seconds_between("start_time", "end_time").alias("duration_seconds")]
    open_ = F.col("end_time").isNull()
    if level == "turn":
        text = {c: F.col(c)["v"].alias(c) for c in ("query", "response")}
        own = [*text.values(), F.col("seconds")["v"].cast("double").alias("response_time_seconds")]
        sizes = [F.length(F.col(c)["v"]).alias(f"{c}_length") for c in text]
        return rows.select(F.col("key").alias(key), *carried, *times, *own, *sizes, (F.col("ended").isNotNull()).alias("is_complete"), "timed_out")
    count = F.col("n").cast("int").alias("interaction_count" if level == "session" else "turn_count")
    return rows.select(F.col("key").alias(key), *carried, *times, count, "last_activity", open_.alias("is_active"), "timed_out")


class Rolling:
    """The roll-ups of one level below ``target``."""

    def __init__(self, spark: SparkSession, level: str, target: str, idle_seconds: int | None = None) -> None:
        self.spark, self.level, self.target, self.idle = spark, level, target.rstrip("/"), idle_seconds

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, [self.target, *parts])))

    def _versions(self, name: str) -> list[int]:
        """Versions of a folder, from the names below it."""
        path = self._path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("version="))

    def _drop(self, name: str, versions: list[int]) -> None:
        for v in versions:
            path = self._path(name, f"version={v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _progress(self) -> tuple[int, object, dict[str, int]]:
        """The last committed version, the latest event of all, and the last batch of each run."""
        for version in reversed(self._versions("progress")):
            rows = self.spark.read.parquet(f"{self.target}/progress/version={version}").collect()  # a row a run
            if rows:
                return version, rows[0].horizon, {r.run: r.batch for r in rows}
        return -1, None, {}

    def _read(self, name: str, versions: list[int], schema) -> DataFrame | None:
        """Rows of some versions, with ``version``."""
        there = [v for v in self._versions(name) if v in versions]
        if not there:
            return None
        reader = self.spark.read.schema(schema).option("basePath", f"{self.target}/{name}")
        return reader.parquet(*(f"{self.target}/{name}/version={v}" for v in there))

    def _schema(self):
        empty = "session_id string, conversation_id string, turn_id string, user_id string, interaction_type string, event_type string, timestamp timestamp, data map<string,string>"
        rows = merged(partials(self.spark.createDataFrame([], empty), self.level), self.level)
        return rows.withColumns({"timed_out": F.lit(False), "version": F.lit(0), "bucket": F.lit(0)}).schema

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of the greatest version of each key."""
        rest = [c for c in rows.columns if c not in ("key", "version")]
        last = rows.groupBy("key").agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("row"))
        return last.select("key", "version", "row.*")

    def fold(self, events: DataFrame, run: str, batch: int) -> None:
        """Bring the roll-ups up to date with a micro-batch."""
        version, horizon, runs = self._progress()
        if runs.get(run, -1) >= batch:
            return
        schema, now = self._schema(), version + 1
        fresh = cut_lineage(partials(events, self.level).withColumn("bucket", self._bucket()))
        latest = fresh.agg(F.max("seen")).first()[0]
        horizon = max((t for t in (horizon, latest) if t is not None), default=None)
        parts = [fresh.drop("bucket")]
        state = self._read("open", [version], schema)
        if state is not None:
            parts.append(state.drop("version", "bucket", "timed_out"))
        closed = self._read("closed", list(range(now)), schema)
        if closed is not None:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            again = closed.filter(F.col("bucket").isin(touched)).join(apart(fresh.select("key")), "key", "left_semi")
            again = self._latest(again)
            if state is not None:
                # A key that was opened again is in the state as a whole.
                again = again.join(apart(state.select("key")), "key", "left_anti")
            parts.append(again.drop("version", "bucket", "timed_out"))
        columns = parts[0].columns
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part.select(*columns))
        idle = F.lit(False)
        if self.idle is not None and horizon is not None:
            idle = F.col("ended").isNull() & (F.col("seen") + F.make_dt_interval(secs=F.lit(self.idle)) < F.lit(horizon))
        rows = cut_lineage(merged(rows, self.level).withColumn("timed_out", idle).withColumn("bucket", self._bucket()))
        done = F.col("ended").isNotNull() | F.col("timed_out")
        rows.filter(~done).drop("version").write.mode("overwrite").parquet(f"{self.target}/open/version={now}")
        final = rows.filter(done)
        old = self._versions("closed")
        if len(old) >= COMPACT_EVERY and closed is not None:
            opened = rows.select("key")
            final = final.unionByName(self._latest(closed).drop("version").join(apart(opened), "key", "left_anti").select(*final.columns))
        final.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/closed/version={now}")
        runs[run] = batch
        committed = self.spark.createDataFrame([(r, b, horizon) for r, b in runs.items()], "run string, batch long, horizon timestamp")
        committed.coalesce(1).write.mode("overwrite").parquet(f"{self.target}/progress/version={now}")
        self._drop("open", [v for v in self._versions("open") if v < version])
        self._drop("progress", [v for v in self._versions("progress") if v < version])
        if len(old) >= COMPACT_EVERY:
            self._drop("closed", [v for v in old if v < now])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")

    def table(self) -> DataFrame:
        """All roll-ups as of the last committed batch."""
        version, schema = self._progress()[0], self._schema()
        found = [self._read("closed", list(range(version + 1)), schema), self._read("open", [version], schema)]
        rows = self.spark.createDataFrame([], schema)
        for part in found:
            rows = rows if part is None else rows.unionByName(part)
        return finished(self._latest(rows), self.level)

    def open_keys(self) -> int:
        """How many keys the state holds."""
        state = self._read("open", [self._progress()[0]], self._schema())
        return 0 if state is None else state.count()


def start_rolling(
    events: DataFrame, level: str, target: str, checkpoint: str, *, idle_seconds: int | None = None, drain: bool = False, every: str = "30 seconds"
) -> StreamingQuery:
    """Keep the roll-ups of a stream of events below ``target``."""
    rolling, run = Rolling(events.sparkSession, level, target, idle_seconds), hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    writer = events.writeStream.foreachBatch(lambda rows, batch: rolling.fold(rows, run, batch)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.start()
