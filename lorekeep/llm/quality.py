"""Quality classifier: random Fourier features and ridge regression (operator 1).

One map turns every text into statistics (``STATISTICS``). On the labelled rows, cosines of
random projections (``FEATURES`` of them) approximate a Gaussian kernel over the standardised
statistics; each task sums its part of the normal equations, one matrix for each fold, the
sums are added up by row of the matrix, and the driver solves systems of ``FEATURES`` + 1
unknowns. Scores of rows that were left out of the fit are calibrated by isotonic regression
over counted bins. Labels, language, source and ids are no input of a score.

Fitting uses ``MAX_LABELLED`` labelled rows at most, taken by a hash of the id; everything
else covers all rows, and the driver holds only matrices of fixed size.

Defined cases: a null text is an empty one and is scored like any other; rows with a null
label or id teach nothing; a document with several labels counts once for each; without
labels, or with one class only, the score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import NOT_SPACE, Texts, byte_table, map_texts, mix, occurred_before, repeated, span_hashes, windows
from lorekeep.session import cut_lineage

FEATURES = 256
RIDGE = 1e-3
MAX_LABELLED = 200_000
# Fixed values of the contract: rows held out, and the score from which a row counts as good.
FOLDS, HELD_OUT = 5, 0
GOOD = 0.3
# Bins of the calibration, over raw scores from -1 to 2.
BINS = 3000
# Tasks that sum normal equations; the labelled rows are bounded.
TASKS = 8

STATISTICS = [
    "log_words", "log_chars", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "top_word",
    "repeated_pairs", "repeated_triples", "upper", "digit", "symbol", "bar", "exclamation", "stop", "comma", "quote", "brace",
    "other_sign", "beyond_ascii", "log_lines", "line_words", "repeated_lines", "same_next", "entropy", "capital_words", "sign_words",
]
_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "symbol": b"#*$%&<>", "bar": b"|", "exclamation": b"!?",
    "stop": b".", "comma": b",;:", "quote": b"\"'`", "brace": b"{}[]()=/\\", "other_sign": b"-_+~^@", "beyond_ascii": range(128, 256),
}
_TABLES = {name: byte_table(members) for name, members in _CLASSES.items()}
_SIGN = byte_table(b"#*$%&<>!?|")


def statistics(t: Texts) -> np.ndarray:
    """``STATISTICS`` of some texts, a row each."""
    size = len(t)
    starts, ends, owner = t.spans(NOT_SPACE[t.data])
    words, length = span_hashes(t.data, starts, ends), (ends - starts).astype(float)
    salt = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = np.bincount(owner, minlength=size)
    one = np.maximum(n, 1)
    count = lambda flags, of=owner: np.bincount(of, flags, size)
    out = {"log_words": np.log1p(n), "log_chars": np.log1p(np.diff(t.offsets))}
    out["word_length"] = count(length) / one
    out["word_length_spread"] = np.sqrt(np.maximum(0, count(length**2) / one - out["word_length"] ** 2))
    out["long_words"], out["short_words"] = count(length > 12) / one, count(length < 3) / one
    _, first, times = np.unique(words + salt, return_index=True, return_counts=True)
    out["distinct_words"] = np.bincount(owner[first], minlength=size) / one
    top = np.zeros(size)
    np.maximum.at(top, owner[first], times)
    out["top_word"] = top / one
    for name, k in (("repeated_pairs", 2), ("repeated_triples", 3)):
        hashes, at = windows(words, owner, k)
        out[name] = count(repeated(mix(hashes + salt[at])), owner[at]) / one
    total = np.maximum(np.diff(t.offsets), 1)
    for name, table in _TABLES.items():
        out[name] = t.per_text(table[t.data]) / total
    ls, le, lo = t.spans(t.data != ord("\n"))
    lines = np.maximum(np.bincount(lo, minlength=size), 1)
    out["log_lines"], out["line_words"] = np.log(lines), np.log1p(n / lines)
    out["repeated_lines"] = np.bincount(lo, occurred_before(lo, span_hashes(t.data, ls, le)), size) / lines
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out["same_next"] = count(same) / one
    out["entropy"] = _entropy(t, total)
    if len(starts):
        out["capital_words"] = count(_TABLES["upper"][t.data[ends - 1]]) / one
        out["sign_words"] = count(_SIGN[t.data[ends - 1]]) / one
    else:
        out["capital_words"] = out["sign_words"] = np.zeros(size)
    return np.column_stack([out[name] for name in STATISTICS])


def _entropy(t: Texts, total: np.ndarray) -> np.ndarray:
    """Bits a byte of each text's own distribution of bytes."""
    out = np.zeros(len(t))
    for k, (a, b) in enumerate(zip(t.offsets, t.offsets[1:])):
        p = np.bincount(t.data[a:b], minlength=256) / total[k]
        p = p[p > 0]
        out[k] = -(p * np.log2(p)).sum()
    return out


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def document_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    return map_texts(docs, "statistics array<double>", lambda t: {"statistics": _listed(statistics(t))}, carry)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Model:
    """Projections, weights (one set a fold left out, and one of all) and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        d = len(mean)
        # A width of the square root of d is the usual distance of two standardised rows.
        self.directions = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: dict[int, np.ndarray] = {}
        self.steps = np.array([0.0]), np.array([0.5])

    def features(self, statistics: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((statistics - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([waves, np.ones(len(z))])

    def raw(self, statistics: np.ndarray, left_out: int) -> np.ndarray:
        return self.features(statistics) @ self.weights[left_out]

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.steps)


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and value of the blocks of the best rising fit (adjacent blocks that violate the
    order are pooled)."""
    blocks: list[list[float]] = []
    for x, g, k in zip(at, good, n):
        blocks.append([x * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x, g, k = np.array(blocks).T
    return x / k, g / k


def fit(labelled: DataFrame, mean: np.ndarray, spread: np.ndarray) -> Model:
    """A model from ``statistics, y, fold``."""
    model = Model(mean, spread)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = shared.value.features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            folds = batch.column(2).to_numpy()
            for k in np.unique(folds).tolist():
                a, b = x[folds == k], y[folds == k]
                part = np.column_stack([a.T @ a, a.T @ b])
                total[k] = total.get(k, 0) + part
        for k, part in total.items():
            rows = len(part)
            columns = [pa.array([k] * rows, pa.int64()), pa.array(range(rows), pa.int32()), _listed(part)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "i", "row"])

    parts = labelled.select("statistics", "y", "fold").mapInArrow(sums, "fold long, i int, row array<double>")
    added = parts.groupBy("fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    equations = {k: np.zeros((FEATURES + 1, FEATURES + 2)) for k in {r.fold for r in added}}
    for r in added:
        equations[r.fold][r.i] = r.row
    if not equations:
        return model
    whole = sum(equations.values())
    n, good = whole[-1, -2], whole[-1, -1]
    if good in (0, n):
        model.weights = {-1: np.zeros(FEATURES + 1)}
        model.steps = np.array([0.0]), np.array([good / n])
        return model
    solve = lambda e: np.linalg.solve(e[:, :-1] + RIDGE * n * np.eye(len(e)), e[:, -1])
    model.weights = {k: solve(whole - e) for k, e in equations.items()} | {-1: solve(whole)}
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, folds = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.zeros(len(y))
            for k in np.unique(folds).tolist():
                raw[folds == k] = shared.value.raw(x[folds == k], k)
            at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])

    bins = labelled.select("statistics", "y", "fold").mapInArrow(binned, "bin int, y double").groupBy("bin")
    counted = sorted(tuple(r) for r in bins.agg(F.sum("y"), F.count("*")).collect())
    at, good, n = np.array(counted, float).T
    model.steps = isotonic((at + 0.5) / BINS * 3 - 1, good, n)
    return model


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; ``labels`` has ``doc_id``
    and ``quality``."""
    found = cut_lineage(document_statistics(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]))
    known = labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")
    )
    known = known.withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    share = min(1.0, max_labelled / max(1, known.count()))
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = cut_lineage(found.join(taken, "doc_id").select("statistics", "y", "fold").repartition(TASKS))
    width = len(STATISTICS)
    each = [f(F.col("statistics")[k]) for f in (F.avg, F.stddev_pop) for k in range(width)]
    measured = np.array([x or 0.0 for x in labelled.agg(*each).first()])
    mean, spread = measured[:width], measured[width:]
    model = fit(labelled, mean, np.where(spread > 1e-9, spread, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            raw = m.raw(_matrix(batch.column(1)), -1) if m.weights and len(batch) else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.calibrated(raw))], names=["doc_id", "score"])

    scored = found.mapInArrow(apply, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"),
    )
