"""An index table that follows a stream of changed texts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

VERSION = "version"
# Of two changes of an id the later one counts, of equal ones the one that arrived later.
ORDER = ("changed_at", "arrived", VERSION)


def start_index_sync(
    changes: DataFrame, target: str, checkpoint: str, embedder: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Embed what arrives (``id, text, changed_at``; a null text removes the id) and
    append it as a new version, the last change of an id only. A micro-batch overwrites
    its own version, so a replay adds nothing; versions are named by the stream (as long as
    its checkpoint lives) and the micro-batch, so that another checkpoint on the same target
    overwrites none."""
    named: list[str] = []

    def stream_id(batch: DataFrame) -> str:
        """The id that the checkpoint keeps."""
        if not named:
            rows = batch.sparkSession.read.text(f"{checkpoint}/metadata").collect()
            named.append(json.loads("".join(r[0] for r in rows))["id"])
        return named[0]

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy("id").agg(
            F.max_by("text", F.struct("changed_at", F.col("text").isNull(), "text")).alias("text"), F.max("changed_at").alias("changed_at")
        ).persist()
        kept = rows.filter(F.col("text").isNotNull())
        vectors = kept.select("id", F.md5("text").alias("text_hash"), "changed_at").join(embedder(kept.select("id", "text")), "id")
        gone = rows.filter(F.col("text").isNull()).select(
            "id", F.lit(None).cast("string").alias("text_hash"), "changed_at", F.lit(None).cast("array<float>").alias("embedding")
        )
        written = vectors.unionByName(gone).withColumn("arrived", F.current_timestamp())
        written.write.mode("overwrite").parquet(f"{target}/{VERSION}={stream_id(batch)}-{epoch:012d}")
        rows.unpersist()

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_index(versions: DataFrame) -> DataFrame:
    """``id, text_hash, embedding``: the latest change of each id that still exists."""
    latest = versions.groupBy("id").agg(F.max_by(F.struct("text_hash", "embedding"), F.struct(*ORDER)).alias("v"))
    return latest.filter(F.col("v.text_hash").isNotNull()).select("id", "v.text_hash", "v.embedding")
