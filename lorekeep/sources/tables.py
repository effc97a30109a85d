"""A store: named Parquet tables in one schema of the session's catalog.

Telemetry tables are partitioned by the day of ``created_at``, so that retention drops
whole partitions and reads of recent data skip the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import embedding
from lorekeep.session import cut_lineage, fresh_path, settings
from lorekeep.sources.schemas import SCHEMAS, conform

DAY = "created_date"
# The partition column of tables that are written batch by batch.
BATCH = "batch"
# The part of an index of vectors that a row is in, by a hash of its id: "3-of-64".
BUCKET = "bucket"
# The tables of the keyword index.
KEYWORDS = ("vertex_numbers", "vertex_postings")


def _bucket(buckets: int) -> Column:
    return F.concat(F.pmod(F.xxhash64("id"), F.lit(buckets)), F.lit(f"-of-{buckets}")).alias(BUCKET)


class Store:
    """Tables below one folder; every method works on whole DataFrames."""

    def __init__(self, spark: SparkSession, schema: str, location: str | None = None) -> None:
        self.spark, self.schema = spark, schema
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}{where}")
        if location:
            self._register()

    def _register(self) -> None:
        """Make the tables that an earlier session left in the store's folder known to this
        one. Folders that begin with an underscore, and tables without rows, are no tables."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.spark.catalog.getDatabase(self.schema).locationUri)
        files = folder.getFileSystem(conf)
        for status in files.listStatus(folder) if files.exists(folder) else []:
            table = status.getPath().getName()
            if not status.isDirectory() or table[0] in "_." or self.exists(table):
                continue
            path = status.getPath().toString()
            if self.spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path").isEmpty():
                continue
            self.spark.sql(f"CREATE TABLE {self.name(table)} USING parquet LOCATION '{path}'")
            if any(c.isPartition for c in self.spark.catalog.listColumns(self.name(table))):
                self.spark.catalog.recoverPartitions(self.name(table))

    @classmethod
    def scratch(cls, spark: SparkSession) -> Store:
        """A new store in the shared folder."""
        path = fresh_path(spark, "store")
        return cls(spark, path.rsplit("/", 1)[1].replace("-", "_"), path)

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def overwrite(self, table: str, rows: DataFrame) -> DataFrame:
        """Replace a table, its schema included."""
        rows.write.mode("overwrite").option("overwriteSchema", "true").format("parquet").saveAsTable(self.name(table))
        return self.read(table)

    def attach(self, table: str, path: str) -> DataFrame:
        """Make existing Parquet files readable as a table of this store."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} USING parquet OPTIONS (path '{path}')")
        return self.read(table)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def read_if_present(self, table: str) -> DataFrame | None:
        return self.read(table) if self.exists(table) else None

    def path(self, label: str) -> str:
        """A place below the store's folder for what is no table."""
        return f"{self.spark.catalog.getDatabase(self.schema).locationUri}/_{label}"

    # Chunk, vector and graph tables

    def write_chunks(self, chunks: DataFrame) -> DataFrame:
        """``id, text, source``, in full; a missing source is "unknown"."""
        return self.overwrite("rag_documents", chunks.select("id", "text", F.coalesce("source", F.lit("unknown")).alias("source")))

    def write_vectors(self, vectors: DataFrame, buckets: int = 0) -> DataFrame:
        """``id, embedding``; bucketed by id if asked for, so that joins on the id need
        no shuffle."""
        if not buckets:
            return self.overwrite("vectors", vectors)
        # One file per bucket, not one per bucket and task.
        placed = vectors.repartition(buckets, "id")
        writer = placed.write.mode("overwrite").format("parquet").bucketBy(buckets, "id").sortBy("id")
        writer.saveAsTable(self.name("vectors"))
        return self.read("vectors")

    def write_index(self, rows: DataFrame, buckets: int = 64) -> DataFrame:
        """``id, text_hash, embedding``, in full, as ``vectors`` in ``buckets`` folders that
        ``refresh_index`` replaces one by one."""
        placed = rows.select("id", "text_hash", "embedding", _bucket(buckets)).hint("rebalance", BUCKET)
        placed.write.mode("overwrite").format("parquet").partitionBy(BUCKET).saveAsTable(self.name("vectors"))
        return self.read("vectors")

    def refresh_index(
        self, source: DataFrame, embedder: Callable[[DataFrame], DataFrame], buckets: int = 64
    ) -> DataFrame:
        """Bring the table of ``write_index`` up to ``source`` (``id, text``), with the rules of
        ``embedding.changed``. Returns ``action, n``; an index that is up to date is not touched.

        Only changed texts are embedded and only buckets with a change are read and written.
        Spark writes them aside and puts them in place when all are complete; each comes out as
        whole files again, so nothing piles up. A refresh that dies half-way is finished by
        the next one, since that compares hashes with what the table then holds. ``buckets``
        counts if the table is empty; else the table's own number stays.
        """
        index, parts = self.read("vectors"), self._partitions("vectors")
        if parts:
            buckets = int(parts[0].rsplit("-", 1)[1])
        plan = cut_lineage(embedding.changed(source, index).withColumn(BUCKET, _bucket(buckets)))
        is_new = F.col("action") != "delete"
        # A row for each bucket.
        touched = plan.groupBy(BUCKET).agg(F.max(is_new).alias("filled")).collect()
        if touched:
            todo = plan.filter(is_new).select("id", "text_hash")
            texts = source.withColumn("text_hash", F.md5("text")).join(todo, ["id", "text_hash"]).dropDuplicates(["id"])
            # Read by the embedder and for the hashes.
            fresh = embedding.index_rows(cut_lineage(texts.select("id", "text")), embedder)
            left = index.filter(F.col(BUCKET).isin([r[BUCKET] for r in touched])).join(plan.select("id"), "id", "left_anti")
            unsure = [r[BUCKET] for r in touched if not r["filled"]]
            gone = set(unsure)
            if unsure:
                gone -= {r[BUCKET] for r in left.filter(F.col(BUCKET).isin(unsure)).select(BUCKET).distinct().collect()}
            columns = ["id", "text_hash", "embedding", BUCKET]
            merged = left.select(columns).unionByName(fresh.withColumn(BUCKET, _bucket(buckets)))
            # Replaces the partitions written and no others.
            with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                merged.hint("rebalance", BUCKET).write.mode("overwrite").insertInto(self.name("vectors"))
            if gone:
                listed = ", ".join(f"PARTITION ({BUCKET} = '{b}')" for b in sorted(gone))
                self.spark.sql(f"ALTER TABLE {self.name('vectors')} DROP IF EXISTS {listed}")
        return plan.groupBy("action").agg(F.count("*").alias("n"))

    def _partitions(self, table: str) -> list[str]:
        """The values of a table's one partition column."""
        return [row[0].split("=", 1)[1] for row in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()]

    def write_cells(self, lists: DataFrame, model: DataFrame) -> DataFrame:
        """The index of cells: lists in order of their cells, and its model."""
        self.overwrite("vector_model", model)
        return self.overwrite("vector_lists", lists)

    def write_graph(self, vertices: DataFrame, edges: DataFrame) -> bool:
        """Both graph tables, or neither if one has no rows. A keyword index of earlier vertices
        goes."""
        if vertices.isEmpty() or edges.isEmpty():
            return False
        for table in KEYWORDS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        self.overwrite("graph_vertices", vertices)
        self.overwrite("graph_edges", edges)
        return True

    def read_graph(self) -> tuple[DataFrame, DataFrame] | None:
        vertices, edges = self.read_if_present("graph_vertices"), self.read_if_present("graph_edges")
        return None if vertices is None or edges is None else (vertices, edges)

    def write_keywords(self, vertices: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The keyword index: vertices by shard and number, postings by bucket, run and block."""
        for table, rows, part, order in zip(KEYWORDS, (vertices, postings), ("shard", "bucket"), (["pos"], ["gram", "block"])):
            # Sorted numbers are packed as their differences, runs without their common beginnings.
            packed = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
            placed = rows.hint("rebalance", part).sortWithinPartitions(part, *order)
            placed.write.mode("overwrite").format("parquet").options(**packed).partitionBy(part).saveAsTable(self.name(table))
        return self.read_keywords()

    def read_keywords(self) -> tuple[DataFrame, DataFrame] | None:
        vertices, postings = map(self.read_if_present, KEYWORDS)
        return None if vertices is None or postings is None else (vertices, postings)

    # Telemetry tables

    def create_telemetry_tables(self, replace: bool = False) -> None:
        """The six tables, empty; existing ones are kept unless ``replace``."""
        for table, schema in SCHEMAS.items():
            if replace or not self.exists(table):
                if replace:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
                columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
                self.spark.sql(
                    f"CREATE TABLE {self.name(table)} ({columns}, {DAY} date) USING parquet PARTITIONED BY ({DAY})"
                )

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows of one of the six tables, as one commit. Rows are brought together
        by day first, so that a day gets few files; a large day splits at run time."""
        ready = conform(rows, table).withColumn(DAY, F.to_date("created_at"))
        ready.hint("rebalance", DAY).write.mode("append").format("parquet").partitionBy(DAY).saveAsTable(self.name(table))
        return self.read(table)

    def replace_batch(self, table: str, rows: DataFrame, batch: str) -> DataFrame:
        """Rows of one batch of ``table``, in place of those an earlier try of it has left; other
        batches stay as they are. ``rows`` is read twice. Every batch has the first one's columns."""
        name, ready = self.name(table), rows.withColumn(BATCH, F.lit(batch))
        if not self.exists(table):
            ready.limit(0).write.format("parquet").partitionBy(BATCH).saveAsTable(name)
        if rows.isEmpty():
            # Nothing would be overwritten.
            value = batch.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({BATCH} = '{value}')")
        else:
            with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                ready.select(self.read(table).columns).write.mode("overwrite").insertInto(name)
        return self.read(table)

    def profile(self, table: str) -> DataFrame:
        """``table, column, type, row_count, files``, or one row with ``error``."""
        out = "table string, column string, type string, row_count long, files long, error string"
        try:
            rows = self.read(table)
            counted = rows.select(F.input_file_name().alias("f")).agg(
                F.count("*").alias("n"), F.count_distinct("f").alias("files")
            ).first()
            listed = [(table, f.name, f.dataType.simpleString(), counted["n"], counted["files"], None) for f in rows.schema]
        except Exception as e:
            listed = [(table, None, None, None, None, str(e).splitlines()[0])]
        return self.spark.createDataFrame(listed, out)

    def cleanup(self, days_to_keep: int = 30, as_of: datetime | None = None) -> dict[str, str | None]:
        """Remove rows created before ``as_of`` less ``days_to_keep`` days from the six
        tables. Returns table → error, if any; one failing table does not stop the rest."""
        outcome: dict[str, str | None] = {}
        for table in SCHEMAS:
            try:
                self._expire(table, days_to_keep, as_of)
                outcome[table] = None
            except Exception as e:
                outcome[table] = str(e).splitlines()[0]
        return outcome

    def _expire(self, table: str, days: int, as_of: datetime | None) -> None:
        """Drop whole days before the cut-off and rewrite the one day it falls into."""
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        cutoff = self.spark.range(1).select((now - F.make_dt_interval(F.lit(days))).alias("t")).first()["t"]
        day = cutoff.date()
        known = self._partitions(table)
        expired = [d for d in known if d < day.isoformat()]
        if day.isoformat() in known:
            rows = self.read(table).filter(F.col(DAY) == F.lit(day))
            left = rows.filter(F.col("created_at") >= F.lit(cutoff))
            if left.isEmpty():
                expired.append(day.isoformat())
            elif not rows.filter(F.col("created_at") < F.lit(cutoff)).isEmpty():
                # Replaces the partitions written and no others.
                with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                    left.write.mode("overwrite").insertInto(self.name(table))
        if expired:
            parts = ", ".join(f"PARTITION ({DAY} = DATE'{d}')" for d in expired)
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS {parts}")
