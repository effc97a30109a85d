"""Statistics on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import stats as s


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 11.0], [3.0, 3.0], [0.0, 10.0, 5.0, 4.999], [1.0]])
def test_histogram(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = s.histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["lower"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r["upper"] for r in got] == pytest.approx(edges[1:].tolist())


def test_histogram_of_nothing(spark):
    assert s.histogram(spark.createDataFrame([], "v double"), "v").collect() == []


def test_correlations(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=50), "b": rng.normal(size=50), "c": 0.7})
    got = {(r["a"], r["b"]): r["correlation"] for r in s.correlations(spark.createDataFrame(frame), ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(frame["a"].corr(frame["b"]))
    assert got["a", "a"] == pytest.approx(1.0)
    assert all(got[p] is None for p in got if "c" in p)


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1, "q", 0.0625), (2, "q", 0.1875), (3, "q", 0.3125)], "case_id int, query string, v double")
    assert [r["v"] for r in s.rounded(df, ["v"]).orderBy("case_id").collect()] == [0.062, 0.188, 0.312]


def test_shares(spark):
    columns = "case_id int, precision double, recall double, accuracy double, f1_score double, semantic_similarity double, answer_quality_score double, response_time double"
    df = spark.createDataFrame([(1, 0.5, 1.0, 0.5, 0.0, 0.3, 0.5, 1.0)], columns)
    got = {r["label"]: r["share"] for r in s.metric_shares(df).collect()}
    assert got == pytest.approx({"Precision": 0.2, "Recall": 0.4, "Accuracy": 0.2, "F1_Score": 0.0, "Answer_Quality": 0.2})
    zero = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], columns)
    assert s.metric_shares(zero).collect() == []


def test_performance_rows(spark):
    columns = "query string, category string, expected_topics array<string>, response string, response_time double, error string"
    long = "Project charter " * 10 + "[SOURCE: x]"
    df = spark.createDataFrame(
        [("q1", "general", ["project", "CHARTER", "vision"], long, 1.5, None), ("q2", "setup", ["a"], None, None, "down")], columns
    )
    ok, failed = s.performance_rows(df).orderBy("query").collect()
    assert (ok["topics_found"], ok["total_topics"], ok["has_sources"], ok["is_comprehensive"], ok["is_concise"]) == (2, 3, True, True, True)
    assert ok["topic_coverage"] == pytest.approx(2 / 3) and ok["response_length"] == len(long)
    assert failed["response_time"] is None and failed["response"] == "Error: down"
    assert (failed["response_length"], failed["topic_coverage"], failed["topics_found"], failed["has_sources"]) == (0, 0.0, 0, False)


def test_head(spark):
    docs = spark.createDataFrame([(n, "s", "x" * (98 + n)) for n in range(7)], "doc_id int, source string, text string")
    rows = s.doc_head(docs).collect()
    assert [r["more"] for r in rows] == [2] * 5
    assert rows[2]["preview"] == "x" * 100 and rows[3]["preview"] == "x" * 100 + "..."
    assert s.doc_head(docs.filter("doc_id < 2")).select(F.max("more")).first()[0] == 0
