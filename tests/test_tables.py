"""The store: schemas, defaults, profiles, retention; embedding and index refresh."""

import os
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import embedding as e
from lorekeep.session import cut_lineage, fresh_path, settings, shared_folder
from lorekeep.sources import corpus
from lorekeep.sources.schemas import SCHEMAS, conform
from lorekeep.sources.tables import DAY, Store

AS_OF = datetime(2024, 1, 31, 12)


def metric_rows(spark, times):
    rows = [(f"m{n}", "t", 1.0, t) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "metric_id string, metric_name string, metric_value double, at string")
    at = F.to_timestamp("at")
    return df.withColumns({"timestamp": at, "created_at": at}).drop("at")


def test_defaults(spark):
    row = conform(spark.createDataFrame([("x", 2.0)], "metric_name string, metric_value double"), "performance_metrics").first()
    assert row["metric_id"] == row["session_id"] == row["turn_id"] == "default"
    assert row["metadata"] == {} and row["metric_unit"] is None and row["created_at"] is not None


def test_required(spark):
    with pytest.raises(ValueError, match="metric_name"):
        conform(spark.createDataFrame([(2.0,)], "metric_value double"), "performance_metrics")
    bad = spark.createDataFrame([(None, 2.0)], "metric_name string, metric_value double")
    with pytest.raises(Exception, match="metric_name is null"):
        conform(bad, "performance_metrics").collect()


def test_schemas(spark):
    assert [len(s.fields) for s in SCHEMAS.values()] == [11, 10, 10, 14, 19, 11]
    store = Store.scratch(spark)
    store.create_telemetry_tables()
    for table, schema in SCHEMAS.items():
        found = [(f.name, f.dataType) for f in store.read(table).schema if f.name != DAY]
        assert found == [(f.name, f.dataType) for f in schema.fields]


def test_create_keeps_rows_unless_told(spark):
    store = Store.scratch(spark)
    store.create_telemetry_tables()
    store.append("performance_metrics", metric_rows(spark, ["2024-01-01 00:00:00"]))
    store.create_telemetry_tables()
    assert store.read("performance_metrics").count() == 1
    store.create_telemetry_tables(replace=True)
    assert store.read("performance_metrics").count() == 0


def test_retention(spark):
    store = Store.scratch(spark)
    store.create_telemetry_tables()
    times = ["2023-12-31 00:00:00", "2024-01-23 23:59:59", "2024-01-24 11:59:59", "2024-01-24 12:00:00", "2024-01-24 13:00:00", "2024-01-30 00:00:00"]
    store.append("performance_metrics", metric_rows(spark, times))
    assert set(store.cleanup(7, AS_OF).values()) == {None}
    left = sorted(r["metric_id"] for r in store.read("performance_metrics").collect())
    assert left == ["m3", "m4", "m5"]
    assert set(store.cleanup(7, AS_OF).values()) == {None}
    assert store.read("performance_metrics").count() == 3
    store.cleanup(7, datetime(2024, 1, 31, 23))
    assert sorted(r["metric_id"] for r in store.read("performance_metrics").collect()) == ["m5"]


def test_retention_goes_on_after_a_failure(spark):
    store = Store.scratch(spark)
    store.create_telemetry_tables()
    spark.sql(f"DROP TABLE {store.name('sessions')}")
    store.append("performance_metrics", metric_rows(spark, ["2023-01-01 00:00:00"]))
    outcome = store.cleanup(7, AS_OF)
    assert outcome["sessions"] and not outcome["performance_metrics"]
    assert store.read("performance_metrics").count() == 0


def test_profile(spark):
    store = Store.scratch(spark)
    store.overwrite("t", spark.range(5).withColumn("x", F.lit("a")))
    rows = store.profile("t").collect()
    assert [(r["column"], r["type"], r["row_count"], r["error"]) for r in rows] == [("id", "bigint", 5, None), ("x", "string", 5, None)]
    assert store.profile("absent").first()["error"]


def test_chunk_table_replaces_its_schema(spark):
    store = Store.scratch(spark)
    store.overwrite("rag_documents", spark.range(3))
    chunks = spark.createDataFrame([("1-0", "x", None), ("1-1", "y", "f")], "id string, text string, source string")
    assert sorted(r["source"] for r in store.write_chunks(chunks).collect()) == ["f", "unknown"]


def test_bucketed_vectors_join_without_a_shuffle(spark):
    store = Store.scratch(spark)
    vectors = spark.range(100).select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    bucketed = store.write_vectors(vectors, buckets=4)
    plan = bucketed.alias("a").hint("merge").join(bucketed.alias("b"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "sample.txt").write_text("Here is a small sample of text about pumps and ponds.")
    (tmp_path / "deep" / "er" / "b.md").write_text("# two\nlines é")
    (tmp_path / "deep" / "no_extension").write_text("")
    got = {r["source"].rsplit("/", 1)[1]: r["text"] for r in corpus.corpus_scan(spark, str(tmp_path)).collect()}
    assert got["sample.txt"] == "Here is a small sample of text about pumps and ponds."
    assert got["b.md"] == "# two\nlines é"
    (tmp_path / "page.HTML").write_text("<html><head><title>t</title></head><p>a&amp;b<br>c</p><script>x()</script></html>")
    plain = {r["source"].rsplit("/", 1)[1]: r["text"] for r in corpus.plain_texts(corpus.corpus_scan(spark, str(tmp_path))).collect()}
    assert plain["page.HTML"] == "a&b c" and plain["b.md"] == "two\nlines é" and plain["sample.txt"] == got["sample.txt"]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        corpus.corpus_scan(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.corpus_scan(spark, str(tmp_path / "absent")).collect()


def test_a_task_scans_many_small_files(spark, tmp_path):
    """Opening a file does not count for 4 MB, in this session or with the settings it has."""
    for n in range(200):
        (tmp_path / str(n)).write_text(str(n))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "16m"}):
        files = corpus.corpus_scan(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= 8
        assert sorted(int(r["text"]) for r in files.collect()) == list(range(200))
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(corpus.OPEN_COST)
    assert not spark.catalog.listTables("global_temp")


def test_files_are_written_as_spark_writes_them(spark, tmp_path):
    """A file a row, below folders of the same names and with the same bytes as Spark's own."""
    langs = ["en", None, "", "pt-BR", "a/b", "x=y z", "q\"%'[]{}^:*?#\\", "tab\there", "EN", "~}"]
    texts = ["one", None, "", "two\nlines\n", "é", "one", "same", "same", "\r\n", " "]
    rows = spark.createDataFrame(list(zip(langs, texts)) * 2, "lang string, text string")
    spark_made, made = tmp_path / "a", tmp_path / "b"
    rows.write.option("maxRecordsPerFile", 1).partitionBy("lang").text(str(spark_made))
    corpus.write_files(rows, str(made), "lang")
    read = lambda top: sorted((p.parent.name, p.read_bytes()) for p in top.rglob("*.txt"))
    assert read(made) == read(spark_made) and len(read(made)) == 20
    assert sum(p.name[0] == "0" for p in made.iterdir()) > 1
    seen = corpus.corpus_scan(spark, str(made)).select("text").collect()
    assert sorted(r["text"] for r in seen) == sorted(f"{t or ''}\n" for t in texts * 2)


def test_a_second_try_of_a_task_adds_no_files(spark, tmp_path):
    """What a task has put in place stays, and what another try left behind is not scanned."""
    rows = spark.createDataFrame([("é", b"a"), ("é", b"b")], "lang string, content binary").coalesce(1)
    for _ in range(2):
        rows.mapInArrow(corpus._files_of_a_task(str(tmp_path), "lang"), "files long").collect()
    got = corpus.corpus_scan(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in got) == ["a", "b"] and all("/lang=%C3%A9/" in r["source"] for r in got)
    with pytest.raises(ValueError, match="there already"):
        corpus.write_files(rows.selectExpr("lang", "'c' AS text"), str(tmp_path), "lang")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    df = cut_lineage(spark.range(3))
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().toString()


def test_embedder(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    vectors = e.embed(docs, "doc_id", e.fit_embedder(docs, 32))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.size("embedding").alias("n"), norm.alias("norm")).collect()
    assert {r["n"] for r in rows} == {32}
    assert all(r["norm"] == pytest.approx(1.0, abs=1e-5) or r["norm"] == 0.0 for r in rows)


def test_own_model(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in range(10)], "id long, text string")
    out = e.embed_with(df, "id", lambda texts: pd.Series([[float(len(t))] for t in texts]), batch=3)
    assert {r["id"]: r["embedding"] for r in out.collect()} == {n: [float(n)] for n in range(10)}


def test_refresh_embeds_only_what_changed(spark):
    source = spark.createDataFrame([(1, "same"), (2, "new text"), (3, "added")], "id long, text string")
    old = spark.createDataFrame([(1, "same", [9.0]), (2, "old", [9.0]), (4, "gone", [9.0])], "id long, text string, embedding array<float>")
    index = old.select("id", F.md5("text").alias("text_hash"), "embedding")
    plan = {r["id"]: r["action"] for r in e.refresh_plan(source, index).collect()}
    assert plan == {1: "keep", 2: "update", 3: "insert", 4: "delete"}
    fresh = e.refreshed_index(source, index, lambda rows: rows.select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")))
    assert {r["id"]: r["embedding"] for r in fresh.collect()} == {1: [9.0], 2: [1.0], 3: [1.0]}


WRITER = """
import sys
from pyspark.sql import functions as F
from lorekeep.session import build_session
from lorekeep.sources.tables import Store
spark = build_session("writer", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.warehouse.dir": sys.argv[2]})
store = Store(spark, "kept", sys.argv[1])
store.write_vectors(spark.range(5).select("id", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")))
edge = spark.createDataFrame([("a", "r", "b")], "src string, relationship string, dst string")
store.write_graph(spark.createDataFrame([("a",), ("b",)], "id string"), edge)
rows = spark.range(3).select(F.col("id").cast("string").alias("metric_id"), F.lit("m").alias("metric_name"),
                             F.col("id").cast("double").alias("metric_value"), F.expr("date_add(date'2024-01-01', int(id))").cast("timestamp").alias("created_at"))
store.append("performance_metrics", rows.withColumn("timestamp", F.col("created_at")))
"""


def test_reopened_by_another_process(spark, tmp_path):
    folder = str(tmp_path / "store")
    environment = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    subprocess.run([sys.executable, "-c", WRITER, folder, str(tmp_path / "w")], env=environment, check=True, timeout=180)
    store = Store(spark, "kept_elsewhere", folder)
    assert store.read("vectors").count() == 5
    vertices, edges = store.read_graph()
    assert vertices.count() == 2 and edges.count() == 1
    assert store.read("performance_metrics").groupBy("created_date").count().count() == 3
    assert Store(spark, "kept_elsewhere", folder).read("vectors").count() == 5
    assert Store(spark, "nothing_there", str(tmp_path / "new")).read_graph() is None
