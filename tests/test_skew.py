"""Hot keys: joins that adaptive execution must be able to split, and does."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import context, graph, metrics
from lorekeep.session import settings

EAGER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def final_plan(df):
    # One and the same execution, so that the plan shown is the one that ran.
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return execution.executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of 60,000 edges leaves one vertex."""
    src = F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), F.col("id") % 5000))
    edges = spark.range(60_000).repartition(16).select(
        src.alias("src"), F.lit("r").alias("relationship"), F.concat(F.lit("n"), F.col("id") % 20_000).alias("dst")
    )
    ids = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("id")).union(spark.createDataFrame([("hub",)], "id string"))
    return ids.distinct(), edges


def test_one_hop_splits_a_hot_vertex(spark, hot):
    vertices, edges = hot
    with settings(spark, EAGER):
        df = graph.one_hop(edges, vertices)
        assert "skew=true" in final_plan(df)
        assert df.agg(F.sum("n")).first()[0] == 60_000


def test_context_splits_a_hot_vertex(spark, hot):
    vertices, edges = hot
    asked = spark.createDataFrame([(1, "hub"), (2, "n1234")], "query_id int, query string")
    with settings(spark, EAGER):
        df = graph.graph_context(asked, vertices, edges, page_lines=1000)
        rows = df.collect()
    pages = [r["context"] for r in sorted(rows, key=lambda r: r["page"]) if r["query_id"] == 1]
    lines = "".join(pages).removeprefix(graph.HEADING).split("\n")
    assert len(lines) == 20_000 and sum(r["query_id"] == 1 for r in rows) == 20


def test_match_splits_a_hot_word(spark):
    vertices = spark.range(3000).select(F.concat(F.lit("entity"), "id").alias("id"))
    text = F.when(F.col("id") % 3 == 0, F.lit("entity1")).otherwise(F.concat(F.lit("entity"), F.col("id") % 3000))
    asked = spark.range(40_000).repartition(16).select(F.col("id").alias("query_id"), text.alias("query"))
    with settings(spark, EAGER):
        df = graph.match_vertices(asked, vertices)
        assert "skew=true" in final_plan(df)
        assert df.select("query_id").distinct().count() == 40_000


def test_texts_split_a_hot_chunk(spark):
    found = spark.range(40_000).repartition(16).select(
        F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("id"),
        F.lit(0.0).alias("distance"),
    )
    texts = spark.range(2000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    with settings(spark, EAGER):
        df = context.attach_text(found, texts)
        assert "skew=true" in final_plan(df)
        assert df.count() == 40_000


def test_a_hot_document_is_split_and_scored(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta word"), "id").alias("text"))
    doc = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("string")
    cases = spark.range(6000).repartition(16).select(
        F.col("id").alias("case_id"), F.lit("alpha question").alias("query"), F.lit("e one").alias("expected_answer"),
        F.lit("a one").alias("actual_answer"), F.array(doc).alias("retrieved_docs"), F.array(F.lit("499")).alias("relevant_docs"),
        F.lit(1.0).alias("response_time"),
    )
    with settings(spark, EAGER):
        df = metrics._retrieved(cases, docs)
        assert "skew=true" in final_plan(df)
        done = metrics.evaluate(cases, docs)
        assert done.count() == 6000
        assert done.filter("avg_relevance_score is null").count() == 0
