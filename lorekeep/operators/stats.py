"""Statistics over results, answers and corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import preview
from lorekeep.operators.metrics import summarise

# Columns of the charts.
CHART_MEANS = ["precision", "recall", "f1_score", "num_retrieved_docs", "num_relevant_docs", "avg_relevance_score", "response_time"]
CORRELATED = ["precision", "recall", "accuracy", "f1_score", "semantic_similarity", "answer_quality_score"]
SHARED = ["avg_precision", "avg_recall", "avg_accuracy", "avg_f1_score", "avg_answer_quality"]
# Fixed value: mark of a cited source in an answer.
SOURCE_MARK = "[source:"


def rounded(results: DataFrame, columns: Sequence[str] = CORRELATED, digits: int = 3) -> DataFrame:
    """Metric columns rounded half to even."""
    return results.select("case_id", "query", *[F.bround(c, digits).alias(c) for c in columns])


def metric_means(results: DataFrame, columns: Sequence[str] = CHART_MEANS) -> DataFrame:
    """``metric, mean``: one aggregation over all columns, turned into rows."""
    means = results.agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot([], list(columns), "metric", "mean")


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin, lower, upper, n``: equal-width bins from minimum to maximum, the last one
    closed. Equal values all fall into the range value ± 0.5. Empty bins are kept."""
    value = F.col(column).cast("double")
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo is not null")
    flat = F.col("lo") == F.col("hi")
    span = ends.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    # The range is one row, read by a scalar subquery and not joined.
    low = span.select("lo").scalar()
    high = span.select("hi").scalar()
    binned = rows.filter(value.isNotNull()).select(
        F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins)).cast("int").alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    frame = span.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("lo") + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def correlations(results: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """``a, b, correlation`` for each ordered pair of columns; null where one of the
    two is constant. All pairs come from one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    name = lambda a, b: f"{a}|{b}"
    spread = [F.stddev_pop(F.col(c).cast("double")).alias(f"sd_{c}") for c in columns]
    # corr() raises an error on a constant column; the covariance does not.
    both = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(name(a, b)) for a, b in pairs]
    return correlation_rows(results.agg(*spread, *both), columns)


def correlation_rows(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, correlation`` from one row of deviations (``sd_a``) and covariances (``a|b``)."""
    pairs = list(combinations_with_replacement(columns, 2))

    def entry(a: str, b: str) -> Column:
        product = F.col(f"sd_{a}") * F.col(f"sd_{b}")
        moving = (F.col(f"sd_{a}") > 1e-12) & (F.col(f"sd_{b}") > 1e-12)
        value = F.when(moving, F.col(f"`{a}|{b}`") / product)
        mirrored = [(a, b)] if a == b else [(a, b), (b, a)]
        return [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), value.alias("correlation")) for x, y in mirrored]

    rows = [row for a, b in pairs for row in entry(a, b)]
    return totals.select(F.inline(F.array(*rows)))


def metric_shares(results: DataFrame, columns: Sequence[str] = SHARED) -> DataFrame:
    """``metric, label, share``: parts of the total of some summary metrics; nothing
    when all are 0."""
    return share_rows(summarise(results), columns)


def share_rows(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The shares of a summary. It is one row, so the total is a sum of its columns."""
    total = reduce(lambda x, y: x + y, [F.col(c) for c in columns])
    label = lambda c: c.replace("avg_", "").title()
    rows = [
        F.struct(F.lit(c).alias("metric"), F.lit(label(c)).alias("label"), (F.col(c) / F.col("total")).alias("share"))
        for c in columns
    ]
    return summary.withColumn("total", total).filter("total > 0").select(F.inline(F.array(*rows)))


def response_flags(response) -> dict[str, Column]:
    """Whether an answer cites sources, is long and is short enough."""
    r = F.col(response) if isinstance(response, str) else response
    return {
        "has_sources": F.contains(F.lower(r), F.lit(SOURCE_MARK)),
        "is_comprehensive": F.length(r) > 100,
        "is_concise": F.length(r) < 1000,
    }


def topics_found(response, topics) -> Column:
    """How many topics occur in the answer, ignoring case."""
    r = F.lower(F.col(response) if isinstance(response, str) else response)
    t = F.col(topics) if isinstance(topics, str) else topics
    return F.size(F.filter(t, lambda topic: F.contains(r, F.lower(topic))))


def performance_rows(answers: DataFrame) -> DataFrame:
    """One row per test case from ``query, category, expected_topics, response,
    response_time, error``. Failed cases stay, with a null time, zero scores, false
    flags and the error as response."""
    ok = F.col("error").isNull()
    found = topics_found("response", "expected_topics")
    total = F.size("expected_topics")
    flags = response_flags("response")
    zero = F.lit(0)
    return answers.select(
        *[c for c in answers.columns if c not in {"expected_topics", "response", "response_time", "error"}],
        F.when(ok, F.col("response_time")).alias("response_time"),
        F.when(ok, F.length("response")).otherwise(zero).alias("response_length"),
        F.when(ok & (total > 0), found / F.nullif(total, zero)).otherwise(0.0).alias("topic_coverage"),
        F.when(ok, found).otherwise(zero).alias("topics_found"),
        total.alias("total_topics"),
        *[F.when(ok, flag).otherwise(F.lit(False)).alias(name) for name, flag in flags.items()],
        F.when(ok, F.col("response")).otherwise(F.concat(F.lit("Error: "), "error")).alias("response"),
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``name, n`` for each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def doc_previews(docs: DataFrame, size: int = 100) -> DataFrame:
    """Preview and length of each document."""
    return docs.select("doc_id", "source", preview("text", size).alias("preview"), F.length("text").alias("length"))


def doc_head(docs: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` documents by id, each with how many more there are."""
    total = docs.agg(F.count("*").alias("n")).select(F.greatest(F.col("n") - n, F.lit(0))).scalar()
    return doc_previews(docs.orderBy("doc_id").limit(n)).withColumn("more", total)
