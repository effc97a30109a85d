"""Which event ids a table has, whatever their day: ids in hash buckets, with Bloom filters.

A batch of ids is first held against the filters of its buckets, a couple of bytes an id stored.
Only for ids that may be known, the repeated ones and one in some thousands of the others, are
the stored ids of their buckets read. Every batch adds its ids and one filter a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import apart, cut_lineage

BUCKETS = 256
# Bits of a filter for each id in it, and places that an id sets.
BITS_PER_ID, PLACES = 24, 8
FILTERS = "bucket int, bits binary"


def keyed(ids: DataFrame) -> DataFrame:
    """``event_id`` with its bucket and the two hashes that give its places."""
    first, second = F.xxhash64("event_id"), F.xxhash64("event_id", F.lit(1))
    return ids.select("event_id", F.pmod(first, F.lit(BUCKETS)).cast("int").alias("bucket"), first.alias("h1"), second.alias("h2"))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    steps = np.arange(PLACES, dtype=np.uint64)
    return ((h1.view(np.uint64)[:, None] >> np.uint64(8)) + steps * (h2.view(np.uint64)[:, None] | np.uint64(1))) % np.uint64(bits)


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """A filter of the ids with these hashes."""
    bits = max(64, 1 << (BITS_PER_ID * len(h1) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[_places(h1, h2, bits).ravel().astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def may_hold(found: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    flags = np.frombuffer(found, np.uint8)
    at = _places(h1, h2, 8 * len(flags)).astype(np.int64)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _hashes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(rows[c].to_numpy()) for c in ("h1", "h2"))


class Ledger:
    """The ids below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.ids, self.filters, self.pending = spark, f"{path}/ids", f"{path}/filters", f"{path}/pending"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def begin(self) -> bool:
        """Mark that a batch is being written; whether one was begun and never ended."""
        broken = self.exists(self.pending)
        files, path = self._path(self.pending)
        files.mkdirs(path)
        return broken

    def end(self) -> None:
        files, path = self._path(self.pending)
        files.delete(path, True)

    def known(self, ids: DataFrame) -> DataFrame | None:
        """The ``event_id``s of ``ids`` that are stored; None where nothing is."""
        if not self.exists(self.filters):
            return None
        asked = cut_lineage(keyed(ids))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        stored = self.spark.read.schema(FILTERS).parquet(self.filters).filter(F.col("bucket").isin(buckets))

        def look(rows: pa.Table, found: pa.Table) -> pa.Table:
            h1, h2 = _hashes(rows)
            maybe = np.zeros(len(h1), bool)
            for bits in found["bits"].to_pylist():
                maybe |= may_hold(bits, h1, h2)
            return rows.select(["event_id", "bucket"]).filter(pa.array(maybe))

        form = asked.select("event_id", "bucket").schema
        likely = cut_lineage(asked.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(look, form))
        buckets = [r[0] for r in likely.select("bucket").distinct().collect()]
        schema = "event_id string, bucket int"
        there = self.spark.read.schema(schema).parquet(self.ids).filter(F.col("bucket").isin(buckets))
        return likely.select("event_id").join(apart(there.select("event_id")), "event_id", "left_semi")

    def add(self, ids: DataFrame) -> None:
        """Store ids. They are all new, so writing them again after a failure does no harm."""
        rows = cut_lineage(keyed(ids))

        def sign(rows: pa.Table) -> pa.Table:
            bits = bloom(*_hashes(rows))
            return pa.table({"bucket": rows["bucket"].slice(0, 1), "bits": pa.array([bits], pa.binary())})

        rows.select("event_id", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.ids)
        signed = rows.groupBy("bucket").applyInArrow(sign, FILTERS)
        signed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.filters)
