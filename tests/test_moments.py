"""Reports from stored moments against the same reports from all results."""

import random

import pytest

from lorekeep.operators import metrics, moments, stats
from lorekeep.plans import flows
from lorekeep.sources.tables import Store

SCHEMA = ", ".join(f"{m} double" for m in moments.METRICS) + ", part int"


def rows_of(n, seed, **fixed):
    rng = random.Random(seed)
    rows = [{m: rng.choice([rng.random(), 0.0, 1.0, None]) for m in moments.METRICS} | fixed for _ in range(n)]
    return [tuple(r[m] for m in moments.METRICS) + (k % 7,) for k, r in enumerate(rows)]


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=lambda r: [str(v) for v in r if not isinstance(v, float)]) for x in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == tuple(v if v is None or isinstance(v, (str, int)) else pytest.approx(v, rel=1e-9, abs=1e-9) for v in y)


def in_parts(results):
    parts = [moments.moments(results.filter(f"part = {k}")) for k in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(200, 1),
        rows_of(60, 2, recall=1e9 + 0.1, precision=None),
        rows_of(3, 3, answer_quality_score=0.1),
        [],
    ],
    ids=["nulls", "constant", "no success", "empty"],
)
def test_reports(spark, rows):
    results = spark.createDataFrame(rows, SCHEMA)
    parts = spark.createDataFrame(in_parts(results).collect(), moments.moments(results).schema)
    columns = metrics.summarise(results).columns
    same(moments.summary(parts).select(columns), metrics.summarise(results))
    same(moments.metric_means(parts), stats.metric_means(results))
    same(moments.correlations(parts), stats.correlations(results))
    same(moments.metric_shares(parts), stats.metric_shares(results))


def test_far_from_zero(spark):
    """Deviations of a millionth around a million: plain sums of squares would lose them."""
    rng = random.Random(5)
    near = [(1e6 + rng.random() * 1e-3, k) for k in range(100)]
    rows = [tuple(x if m == "recall" else 2 * x if m == "precision" else 0.5 for m in moments.METRICS) + (k % 5,) for x, k in near]
    parts = in_parts(spark.createDataFrame(rows, SCHEMA))
    found = {(r["a"], r["b"]): r["correlation"] for r in moments.correlations(parts).collect()}
    assert found["recall", "precision"] == pytest.approx(1.0, abs=1e-4) and found["recall", "accuracy"] is None


def test_batches_are_replaced(spark):
    store = Store.scratch(spark)
    rows = lambda *values: spark.createDataFrame([(v,) for v in values], "x int")
    read = lambda: sorted(tuple(r) for r in store.read("some").select("batch", "x").collect())
    store.replace_batch("some", rows(1, 2), "a")
    store.replace_batch("some", rows(3), "it's")
    assert read() == [("a", 1), ("a", 2), ("it's", 3)]
    store.replace_batch("some", rows(4), "a")
    assert read() == [("a", 4), ("it's", 3)]
    store.replace_batch("some", rows(), "it's")
    assert read() == [("a", 4)]


def test_evaluate_batch(spark):
    schema = "query string, expected_answer string, actual_answer string, retrieved_docs array<string>, relevant_docs array<string>, response_time double"
    case = lambda n: (f"question {n}", "the pond has two pumps", f"the pond has {n} pumps", ["d1", "d2"], ["d1"], float(n))
    cases = lambda *n: spark.createDataFrame([(k, *case(k)) for k in n], f"case_id long, {schema}")
    store = Store.scratch(spark)
    flows.evaluate_batch(store, cases(1, 2), "monday")
    flows.evaluate_batch(store, cases(3), "tuesday")
    parts = flows.evaluate_batch(store, cases(3, 4, 5), "tuesday")
    assert sorted(r["case_id"] for r in store.read("case_results").collect()) == [1, 2, 3, 4, 5]
    whole = metrics.summarise(metrics.evaluate(cases(1, 2, 3, 4, 5)))
    same(moments.summary(parts).select(whole.columns), whole)
