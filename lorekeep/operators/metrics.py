"""Scores of answered questions.

A case has ``case_id``, ``query``, ``expected_answer``, ``actual_answer``,
``retrieved_docs`` and ``relevant_docs`` (arrays of texts, or of document ids when a
``docs`` table resolves them) and ``response_time``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import clarity, completeness, is_blank, length_score
from lorekeep.operators.similarity import pair_similarity

REQUIRED = ["query", "expected_answer", "actual_answer"]
# Fixed value: a score above it counts as relevant, a quality above it as success.
THRESHOLD = 0.5

SUMMARY_MEANS = {
    "avg_precision": "precision",
    "avg_recall": "recall",
    "avg_accuracy": "accuracy",
    "avg_f1_score": "f1_score",
    "avg_semantic_similarity": "semantic_similarity",
    "avg_answer_quality": "answer_quality_score",
    "avg_response_time": "response_time",
}


def _hits(retrieved, relevant) -> Column:
    return F.size(F.array_intersect(retrieved, relevant))


def precision(retrieved, relevant) -> Column:
    """Distinct hits over the length of the retrieved list; 0 when nothing was retrieved."""
    return F.when(F.size(retrieved) == 0, 0.0).otherwise(
        _hits(retrieved, relevant) / F.nullif(F.size(retrieved), F.lit(0))
    )


def recall(retrieved, relevant) -> Column:
    """Distinct hits over the length of the relevant list; with none relevant,
    1 if nothing was retrieved either and else 0."""
    return (
        F.when(F.size(relevant) > 0, _hits(retrieved, relevant) / F.nullif(F.size(relevant), F.lit(0)))
        .when(F.size(retrieved) == 0, 1.0)
        .otherwise(0.0)
    )


def f1_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def accuracy(predicted, truth) -> Column:
    """Share of equal labels in two arrays; unequal lengths are an error."""
    same = F.size(F.filter(F.zip_with(predicted, truth, lambda p, t: p == t), lambda x: x))
    return F.when(
        F.size(predicted) != F.size(truth),
        F.raise_error(F.lit("predicted and true labels must have the same length")).cast("double"),
    ).otherwise(same / F.size(predicted))


def answer_quality(similarity, answer, expected) -> Column:
    """Weighted similarity, length, completeness and clarity, within [0, 1]."""
    score = (
        0.4 * similarity
        + 0.2 * length_score(answer, expected)
        + 0.2 * completeness(answer, expected)
        + 0.2 * clarity(answer)
    )
    return F.when(is_blank(answer) | is_blank(expected), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    )


def with_defaults(cases: DataFrame) -> DataFrame:
    """Missing lists become empty and a missing time 0.0."""
    empty = F.array().cast("array<string>")
    return cases.withColumns(
        {
            "retrieved_docs": F.coalesce("retrieved_docs", empty),
            "relevant_docs": F.coalesce("relevant_docs", empty),
            "response_time": F.coalesce("response_time", F.lit(0.0)),
        }
    )


def _complete() -> Column:
    present = [F.col(c).isNotNull() for c in REQUIRED]
    return present[0] & present[1] & present[2]


def normalised_cases(cases: DataFrame) -> DataFrame:
    """Cases that can be scored: required fields present and something retrieved
    (accuracy over no document is undefined)."""
    return with_defaults(cases).filter(_complete() & (F.size("retrieved_docs") > 0))


def rejected_cases(cases: DataFrame) -> DataFrame:
    """``case_id`` and ``reason`` of the cases :func:`normalised_cases` leaves out."""
    reason = F.when(~_complete(), "missing field").when(F.size("retrieved_docs") == 0, "nothing retrieved")
    return with_defaults(cases).select("case_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def _retrieved(cases: DataFrame, docs: DataFrame | None) -> DataFrame:
    """One row per retrieved document: ``case_id, pos, query, doc, is_relevant``."""
    rows = cases.select(
        "case_id", "query", "relevant_docs", F.posexplode("retrieved_docs").alias("pos", "doc")
    ).select("case_id", "pos", "query", "doc", F.array_contains("relevant_docs", F.col("doc")).alias("is_relevant"))
    if docs is None:
        return rows.withColumn("text", F.col("doc"))
    # Only documents that need a text are looked up; a document many cases share makes
    # a skewed join key, which adaptive execution splits on this side.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")
    return rows.join(texts, "doc", "left").select("case_id", "pos", "query", "doc", "is_relevant", "text")


def relevance_scores(
    cases: DataFrame, docs: DataFrame | None = None, *, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """``case_id, pos, doc, is_relevant, score``: 1.0 for a relevant document, else the
    similarity of question and document."""
    rows = _retrieved(normalised_cases(cases), docs)
    return _score_rows(rows, stop_words)


def _score_rows(rows: DataFrame, stop_words) -> DataFrame:
    pairs = rows.filter(~F.col("is_relevant")).select("case_id", "pos", "query", "text")
    scored = pair_similarity(pairs, ["case_id", "pos"], "query", "text", stop_words=stop_words)
    return rows.join(scored, ["case_id", "pos"], "left").select(
        "case_id",
        "pos",
        "doc",
        "is_relevant",
        F.when(F.col("is_relevant"), 1.0).otherwise(F.col("similarity")).alias("score"),
    )


def relevance_labels(scores: DataFrame) -> DataFrame:
    """Predicted and true label of each retrieved document."""
    return scores.select(
        "case_id",
        "pos",
        "doc",
        (F.col("score") > THRESHOLD).alias("predicted"),
        F.col("is_relevant").alias("truth"),
    )


def relevance_lists(scores: DataFrame) -> DataFrame:
    """``case_id`` and its ``relevance_scores`` in retrieval order. A list is as long as
    the case's own list of retrieved documents."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "score")))
    return scores.groupBy("case_id").agg(F.transform(ordered, lambda s: s["score"]).alias("relevance_scores"))


def label_accuracy(labels: DataFrame) -> DataFrame:
    """Accuracy per case from label rows."""
    return labels.groupBy("case_id").agg(
        F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy")
    )


def evaluate(
    cases: DataFrame, docs: DataFrame | None = None, *, stop_words: Sequence[str] | None = None
) -> DataFrame:
    """One result row per scorable case.

    Every text pair of a case, the two answers as well as question and document, goes
    through one :func:`pair_similarity`. A relevant document scores 1.0 and is labelled
    rightly by definition, so accuracy and mean relevance are plain sums per case.
    """
    ready = normalised_cases(cases)
    rows = _retrieved(ready, docs).filter(~F.col("is_relevant"))
    answers = ready.select(
        "case_id", F.lit(-1).alias("pos"), F.col("expected_answer").alias("a"), F.col("actual_answer").alias("b")
    )
    questions = rows.select("case_id", "pos", F.col("query").alias("a"), F.col("text").alias("b"))
    similarity = pair_similarity(
        answers.unionByName(questions), ["case_id", "pos"], "a", "b", stop_words=stop_words
    )
    is_doc = F.col("pos") >= 0
    per_case = similarity.groupBy("case_id").agg(
        F.max(F.when(~is_doc, F.col("similarity"))).alias("semantic_similarity"),
        F.count_if(is_doc).alias("others"),
        F.count_if(is_doc & (F.col("similarity") <= THRESHOLD)).alias("others_right"),
        F.sum(F.when(is_doc, F.col("similarity")).otherwise(0.0)).alias("others_score"),
    )
    n = F.size("retrieved_docs")
    marked = n - F.col("others")
    p, r = precision(F.col("retrieved_docs"), F.col("relevant_docs")), recall(F.col("retrieved_docs"), F.col("relevant_docs"))
    return (
        ready.join(per_case, "case_id")
        .withColumns({"precision": p, "recall": r})
        .select(
            "case_id",
            "query",
            "expected_answer",
            "actual_answer",
            "response_time",
            "precision",
            "recall",
            ((marked + F.col("others_right")) / n).alias("accuracy"),
            f1_score(F.col("precision"), F.col("recall")).alias("f1_score"),
            "semantic_similarity",
            answer_quality(F.col("semantic_similarity"), "actual_answer", "expected_answer").alias(
                "answer_quality_score"
            ),
            n.alias("num_retrieved_docs"),
            # The reference reports the number of scored documents under this name.
            n.alias("num_relevant_docs"),
            F.size("relevant_docs").alias("num_relevant_true"),
            ((marked + F.col("others_score")) / n).alias("avg_relevance_score"),
        )
    )


def summarise(results: DataFrame) -> DataFrame:
    """Means, row count and success count; no row for no results."""
    return (
        results.agg(
            *[F.avg(column).alias(name) for name, column in SUMMARY_MEANS.items()],
            F.count("*").alias("total_queries"),
            F.count_if(F.col("answer_quality_score") > THRESHOLD).alias("successful_queries"),
        )
        .filter(F.col("total_queries") > 0)
    )
