"""Stored moments of results: summaries of all batches without evaluating or reading them again.

A batch of results leaves one row for each pair of metrics that a report needs: how many rows
have both, their means and the sum of the products of their deviations. Such rows merge in any
order and lose no precision by it, since sums of squares are never subtracted from each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import stats
from lorekeep.operators.metrics import SUMMARY_MEANS, THRESHOLD

# Counted only: every row, and rows whose answer is good enough.
ROWS, SUCCESSES = "rows", "successes"
METRICS = sorted({*SUMMARY_MEANS.values(), *stats.CHART_MEANS, *stats.CORRELATED})


def moments(results: DataFrame) -> DataFrame:
    """``a, b, n, mean_a, mean_b, product`` of the rows of ``results`` where both metrics are
    known; no rows for no results. Combines within each task."""
    pairs = [(m, m) for m in METRICS] + list(combinations(stats.CORRELATED, 2))
    value = {m: F.col(m).cast("double") for m in METRICS}
    value[ROWS] = F.lit(1.0)
    value[SUCCESSES] = F.when(F.col("answer_quality_score") > THRESHOLD, 1.0)
    listed = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value[a].alias("x"), value[b].alias("y"))
        for a, b in [*pairs, (ROWS, ROWS), (SUCCESSES, SUCCESSES)]
    ]
    rows = results.select(F.inline(F.array(*listed))).filter("x is not null and y is not null")
    return rows.groupBy("a", "b").agg(
        F.count("*").alias("n"),
        _between(F.avg("x"), F.min("x"), F.max("x")).alias("mean_a"),
        _between(F.avg("y"), F.min("y"), F.max("y")).alias("mean_b"),
        (F.covar_pop("x", "y") * F.count("*")).alias("product"),
    )


def _between(mean: Column, least: Column, most: Column) -> Column:
    """A mean without the rounding that takes it out of its range, so that a constant has itself
    for a mean and no deviations."""
    return F.greatest(least, F.least(most, mean))


def merged(parts: DataFrame) -> DataFrame:
    """Moments of all batches together, from those of each: one row a pair."""
    pair = Window.partitionBy("a", "b")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair)
    mean = lambda c: _between(weighted(c), F.min(c).over(pair), F.max(c).over(pair))
    rows = parts.withColumns({"all_a": mean("mean_a"), "all_b": mean("mean_b")})
    apart = F.col("n") * (F.col("mean_a") - F.col("all_a")) * (F.col("mean_b") - F.col("all_b"))
    return rows.groupBy("a", "b").agg(
        F.sum("n").alias("n"),
        F.max("all_a").alias("mean_a"),
        F.max("all_b").alias("mean_b"),
        F.sum(F.col("product") + apart).alias("product"),
    )


def _row(parts: DataFrame, wanted: Mapping[str, tuple[str, str, Column]]) -> DataFrame:
    """One row with a column for each name: a value of the pair it comes with."""
    of = lambda a, b, value: F.max(F.when((F.col("a") == a) & (F.col("b") == b), value))
    return merged(parts).agg(*[of(*pair).alias(name) for name, pair in wanted.items()])


def summary(parts: DataFrame) -> DataFrame:
    """As ``metrics.summarise`` of all results."""
    means = {name: (m, m, F.col("mean_a")) for name, m in SUMMARY_MEANS.items()}
    counts = {"total_queries": (ROWS, ROWS, F.col("n")), "successful_queries": (SUCCESSES, SUCCESSES, F.col("n"))}
    found = _row(parts, means | counts).filter("total_queries > 0")
    return found.withColumn("successful_queries", F.coalesce("successful_queries", F.lit(0).cast("long")))


def metric_means(parts: DataFrame, columns: Sequence[str] = stats.CHART_MEANS) -> DataFrame:
    """As ``stats.metric_means`` of all results."""
    return _row(parts, {c: (c, c, F.col("mean_a")) for c in columns}).unpivot([], list(columns), "metric", "mean")


def correlations(parts: DataFrame, columns: Sequence[str] = stats.CORRELATED) -> DataFrame:
    """As ``stats.correlations`` of all results."""
    spread = {f"sd_{c}": (c, c, F.sqrt(F.col("product") / F.col("n"))) for c in columns}
    both = {f"{a}|{b}": (a, b, F.col("product") / F.col("n")) for a, b in [*combinations(columns, 2), *zip(columns, columns)]}
    return stats.correlation_rows(_row(parts, spread | both), columns)


def metric_shares(parts: DataFrame, columns: Sequence[str] = stats.SHARED) -> DataFrame:
    """As ``stats.metric_shares`` of all results."""
    return stats.share_rows(summary(parts), columns)
