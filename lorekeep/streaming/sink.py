"""Telemetry events from a stream into a table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lorekeep.session import apart, cut_lineage
from lorekeep.sources.schemas import conform, required
from lorekeep.sources.tables import DAY
from lorekeep.streaming.ledger import Ledger


def read_events(spark: SparkSession, folder: str, schema: T.StructType, *, max_files: int | None = None) -> DataFrame:
    """A stream over Parquet files as they arrive, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def append_new(rows: DataFrame, target: str) -> None:
    """Append the rows whose ``event_id`` is not yet in the table below ``target``, whatever the
    day of either. Ids are looked up in the ledger beside the table, see :mod:`ledger`.

    Nothing is forgotten and no event is dropped for its age. A batch that failed after its
    events were written and before its ids were is found by the mark it left: the ids of the
    table are then read once, and those of the batch that are there go to the ledger.
    """
    spark, ids = rows.sparkSession, Ledger(rows.sparkSession, f"{target.rstrip('/')}_ids")
    kept = cut_lineage(rows.dropDuplicates(["event_id"]))
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    written = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if kept.isEmpty():
        return
    # A table from before there was a ledger, or a batch that was not ended.
    if ids.begin() or (written and not ids.exists(ids.ids)):
        _enter(target, kept, ids, written)
    known = ids.known(kept.select("event_id"))
    fresh = kept if known is None else cut_lineage(kept.join(apart(known), "event_id", "left_anti"))
    if not fresh.isEmpty():
        fresh.write.mode("append").partitionBy(DAY).parquet(target)
        ids.add(fresh.select("event_id"))
    ids.end()


def _enter(target: str, rows: DataFrame, ids: Ledger, written: bool) -> None:
    """Bring the ledger up to date with the events of a table: with all of them where there is
    no ledger, else with those of a batch that was not ended."""
    if not written:
        return
    there = rows.sparkSession.read.schema(rows.schema).parquet(target)
    if ids.exists(ids.ids):
        there = there.join(apart(rows.select("event_id")), "event_id", "left_semi")
    there = cut_lineage(there.select("event_id").distinct())
    known = ids.known(there)
    missing = there if known is None else there.join(apart(known), "event_id", "left_anti")
    if not missing.isEmpty():
        ids.add(missing)


def start_sink(
    events: DataFrame, target: str, checkpoint: str, *, drain: bool = False, every: str = "30 seconds"
) -> StreamingQuery:
    """Write events to the interactions layout below ``target``, partitioned by day.

    A batch every ``every``, or with ``drain`` all there is and then stop. Each event appears
    once, also when it is sent again, late, or after a restart. Rows without a required
    value go to the folder ``target`` + ``_rejected``, by run, and do not stop the stream.
    """
    folder = f"{target.rstrip('/')}_rejected/run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"

    def write(rows: DataFrame, batch: int) -> None:
        broken = F.lit(False)
        for name in required("user_interactions"):
            broken = broken | F.col(name).isNull()
        rows.filter(broken).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        sound = conform(rows.filter(~broken), "user_interactions")
        append_new(sound.withColumn(DAY, F.to_date("created_at")), target)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.start()
