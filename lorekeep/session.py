"""Session settings and the shared scratch folder."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# So many intermediate results are written before plans that are done are let go.
RELEASE_EVERY = 6
_written = itertools.count(1)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator relies on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lorekeep-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Have Spark remove the broadcasts and shuffle files that no plan can reach any more. It
    does so when the driver's JVM collects their handles, by itself only twice an hour; a job of
    many short stages would carry them all, on the driver and on the executors' disks."""
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once
    and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    df.write.parquet(path)
    if next(_written) % RELEASE_EVERY == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` behind a shuffle of its own, for a side of a join that was grouped by the
    join key. Adaptive execution splits a hot key only where both sides of a join come
    straight from their shuffles; grouped rows are few next to the other side."""
    return df.hint("rebalance")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the length of a block."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stream_settings(spark: SparkSession):
    """State in RocksDB, with as many state partitions as the cluster has use for.

    A stateful stream keeps the partition count it starts with, so it is taken from
    the cluster's parallelism and not from a batch default.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settings(
        spark,
        {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.shuffle.partitions": str(parts),
        },
    )
