"""Scans of document folders."""

from __future__ import annotations

import errno
import os
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import markdown_text, page_text
from lorekeep.session import settings

# Bytes that opening a file counts for when files are dealt to tasks. With Spark's 4 MB no task
# gets more than 32 files, however short they are.
OPEN_COST = 1 << 16
# Folders beyond which they are listed in tasks and not by the driver.
LISTED_FOLDERS = 1
# What Spark escapes in the name of a partition's folder, and its name for null and "". Letters
# beyond ASCII are escaped as well: not every JVM finds such names again.
ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]|[^\x00-\x7f]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """``source, text``: each file below ``folder``, of any extension, as one text.

    A missing folder, an unreadable file and bytes that are no UTF-8 are errors. Files
    are listed by Spark, and many small ones share a task.
    """
    # What opening costs is a setting of the session that a table of files was made in. A global
    # view brings the table here and leaves this session's settings as they are.
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", str(LISTED_FOLDERS))
    view = f"files_{uuid.uuid4().hex}"
    (
        own.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", False)
        .option("ignoreMissingFiles", False)
        .load(folder)
        .createGlobalTempView(view)
    )
    files = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    spark.catalog.dropGlobalTempView(view)
    return files.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))


def _files_of_a_task(path: str, by: str):
    """Writes the rows of a task into a folder that is put in place when all are there. Another
    try of the same task leaves the folder as the first one put it."""

    def write(batches):
        part, files = TaskContext.get().partitionId(), 0
        hidden = f"{path}/_{uuid.uuid4().hex}"
        for batch in batches:
            for value, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = ESCAPED.sub(lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), value or "") or NO_VALUE
                folder = f"{hidden}/{by}={name}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{files}.txt", "wb") as file:
                    file.write(content.as_buffer())
                files += 1
        if files:
            try:
                os.rename(hidden, f"{path}/{part:05d}")
            except OSError as error:
                if error.errno not in (errno.EEXIST, errno.ENOTEMPTY):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_files(rows: DataFrame, path: str, by: str) -> None:
    """A file for each row's ``text``, ended by a line break, below a folder named by the
    column ``by`` as Spark names partitions. ``path`` must not be there yet.

    In the local file system Hadoop starts processes for the permissions of each file, so there
    tasks write the files themselves; in any other store Spark's writer does.
    """
    spark = rows.sparkSession
    rows = spread(rows.select(by, "text"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    where = store.makeQualified(folder).toUri()
    if where.getScheme() != "file":
        # Tasks move their files into place themselves; by default the driver moves all of them,
        # one after another.
        writer = rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy(by).text(path)
        return
    if store.exists(folder):
        raise ValueError(f"{path} is there already")
    store.mkdirs(folder)
    content = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\n")).cast("binary")
    files = rows.select(F.col(by).cast("string"), content.alias("content"))
    # Small batches, so that long texts do not pile up in a worker.
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}):
        files.mapInArrow(_files_of_a_task(where.getPath(), by), "files long").write.format("noop").mode("overwrite").save()


def plain_texts(files: DataFrame) -> DataFrame:
    """``source, text`` with the mark-up of HTML and markdown files taken out."""
    name = F.lower("source")
    text = (
        F.when(name.rlike(r"\.x?html?$"), page_text("text"))
        .when(name.rlike(r"\.(md|markdown)$"), markdown_text("text"))
        .otherwise(F.col("text"))
    )
    return files.withColumn("text", text)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a scan gives fewer partitions than that, for work that
    costs far more than moving a row. A large table has more splits than the cluster has
    cores and is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of raw web pages."""
    return pages.select("page_id", "url", page_text("html").alias("text"))
