"""Physical plans: what is read, what is pushed down, what is shuffled, what is joined how."""

import re

import pytest

from lorekeep.operators.similarity import pair_similarity
from lorekeep.plans import inputs
from lorekeep.plans.registry import QUERIES

LAZY = [
    "page_text", "clean_text", "text_stats", "chunk_fixed", "chunk_recursive", "response_flags", "topic_coverage",
    "performance_rows", "valid_questions", "cases_normalised", "precision", "tfidf_similarity", "answer_quality",
    "relevance_scores", "eval_rows", "eval_summary", "metric_corr", "metric_share", "response_time_hist", "knn_l2",
    "retrieve_chunks", "rag_prompt", "llm_requests", "llm_responses", "extract_triples", "extraction_parse",
    "vertex_keyword", "seed_edges", "motif_one_hop", "graph_context", "event_query", "answer_events", "session_rollup",
    "conversation_rollup", "turn_rollup", "turn_pairs", "index_refresh", "chunk_ids", "doc_head",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name,columns",
    [
        ("knn_l2", {"vec_id", "embedding"}),
        ("clean_text", {"doc_id", "text"}),
        ("precision", {"conv_id", "turn", "role", "text", "doc_id", "quality", "event_id"}),
        ("session_rollup", {"event_id", "ts", "user_id", "event_type"}),
        ("turn_pairs", {"conv_id", "turn", "role", "text"}),
    ],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan(QUERIES[name](spark, small)))
    read = {c for s in schemas for c in re.findall(r"(?:^|,)(\w+):", s)}
    assert schemas and read <= columns


def test_filters_reach_the_scan(spark, small):
    assert "EqualTo(quality,1)" in plan(inputs.eval_cases(spark, small))
    assert "EqualTo(role,user)" in plan(QUERIES["event_query"](spark, small))
    assert "EqualTo(event_type,click)" in plan(QUERIES["event_click"](spark, small))


def test_similarity_shuffles_texts_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = plan(pair_similarity(docs, ["doc_id"], "text", "source"))
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text


def test_top_k_is_cut_before_the_shuffle(spark, small):
    text = plan(QUERIES["knn_l2"](spark, small))
    assert re.search(r"WindowGroupLimit.*Final(?s:.*)Exchange(?s:.*)WindowGroupLimit.*Partial", text)


def test_rollups_combine_before_the_shuffle(spark, small):
    for name in ("session_rollup", "conversation_rollup", "turn_rollup"):
        assert "partial_min" in plan(QUERIES[name](spark, small))


def test_similarity_takes_more_tasks_for_more_text(spark, monkeypatch):
    """Tasks follow the amount of text, which adaptive execution must not put together again."""
    docs = spark.createDataFrame([(n, "red pump " * 200, "blue pump") for n in range(60)], "n int, a string, b string")
    monkeypatch.setattr("lorekeep.operators.similarity.TASK_CHARS", 4000)
    found = pair_similarity(docs, ["n"], "a", "b")
    chars = 60 * len("red pump " * 200 + "blue pump")
    assert f", {-(-chars // 4000)}), REPARTITION_BY_NUM" in plan(found)
    assert found.count() == 60 and pair_similarity(docs.limit(0), ["n"], "a", "b").isEmpty()


def test_evaluations_take_more_tasks_for_more_text(spark, small, monkeypatch):
    """Labels, rows and reports of evaluations all count terms in as many tasks as the texts need."""
    monkeypatch.setattr("lorekeep.operators.similarity.TASK_CHARS", 2000)
    for name in ("relevance_scores", "eval_rows", "metric_corr"):
        dealt = re.findall(r"hashpartitioning\(case_id\S*, pos\S*, (\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, small)))
        assert dealt and min(map(int, dealt)) > 2 * spark.sparkContext.defaultParallelism, name
