"""Language identification by Bayesian fusion of evidence (operator 7).

Text: character trigrams (``BUCKETS`` by hash) under a multinomial model for each language,
counted over all texts that declare one; as trigrams of a text depend on each other, a text
counts for ``TRUST`` independent ones at most. Markup: the declared language, weighed by how
often declarations of that kind agree with the text. Address: hosts and their suffix; a host's
prior is smoothed by its suffix's, and that by the corpus's, all from grouped sums of what the
texts say, the document itself left out. The three are multiplied.

The model has a table of ``BUCKETS`` numbers a language, whatever the corpus. Texts are read
twice and never shuffled; sums and joins are over rows of a few numbers, and a hot host or
suffix is one row on one side of a join.

Probabilities compare the known languages only, so a text must also be known at all: under its
likeliest language its trigrams have to be likelier, on average, than under a background in
which all buckets are equally likely. What no text of a language has seen weighs the same for
all languages (``UNSEEN``), however much text they have.

Defined cases: a text without letters and a null text have no language and are rejected;
evidence that is missing says nothing; where no text declares a language, all are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER, Texts, byte_table, mix, row_key, small_batches, texts_of
from lorekeep.session import apart, cut_lineage

BUCKETS = 1 << 15
TRUST = 40
# Rows that a level of the hierarchy weighs as much as, for the level below.
PRIOR_ROWS = 5.0
# A language is accepted from this probability.
LEAST = 0.5
# Share of a language's probability that is spread evenly over all buckets.
UNSEEN = 0.01
# Mean log probability a trigram under the background.
BACKGROUND = -float(np.log(BUCKETS))

# What names that stand for a missing one begin with.
NONE = "\0"
_LETTER = byte_table(bytes([*range(97, 123), *range(128, 256)]))


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every letter, and where each text's begin. Anything but a
    letter, and either end of a text, counts as blank."""
    data = LOWER[t.data]
    letter = _LETTER[data]
    code = np.where(letter, data, 32).astype(np.uint64)
    before, after = (np.full(len(code), 32, np.uint64) for _ in range(2))
    before[1:], after[:-1] = code[:-1], code[1:]
    edge = np.zeros(len(code) + 1, bool)
    edge[t.offsets] = True
    before[edge[:-1]] = 32
    after[edge[1:]] = 32
    at = np.flatnonzero(letter)
    around = before[at] | code[at] << np.uint64(8) | after[at] << np.uint64(16)
    return (mix(around) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(at, t.offsets)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket, from ``text`` and ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            done, langs = 0, batch.column(1).to_pylist()
            for t in texts_of(batch.column(0)):
                ids, begins = trigrams(t)
                own = langs[done : done + len(t)]
                done += len(t)
                for lang in set(own):
                    flags = np.repeat([x == lang for x in own], np.diff(begins))
                    total[lang] = total.get(lang, 0) + np.bincount(ids[flags], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    declared = docs.filter("lang is not null and text is not null").select("text", "lang")
    counted = declared.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    for batch in counted.toArrow().to_batches():
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs):
            here = langs == lang
            tables.setdefault(lang, np.zeros(BUCKETS))[batch.column(1).to_numpy()[here]] = batch.column(2).to_numpy()[here]
    names = sorted(tables)
    n = np.array([tables[x] for x in names]).reshape(len(names), BUCKETS)
    return names, np.log((1 - UNSEEN) * n / np.maximum(n.sum(axis=1, keepdims=True), 1) + UNSEEN / BUCKETS)


def _text_evidence(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, row, source, trigrams, evidence``: log likelihood of each language, tempered."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for t in texts_of(batch.column(3)):
                ids, begins = trigrams(t)
                n = np.diff(begins)
                sums = []
                for row in shared.value:
                    total = np.concatenate([[0.0], np.cumsum(row[ids])])
                    sums.append((total[begins[1:]] - total[begins[:-1]]) / (np.maximum(n, 1) * (1 / TRUST + 1 / np.maximum(n, 1))))
                own = batch.slice(done, len(t))
                done += len(t)
                flat = pa.array(np.column_stack(sums).ravel())
                evidence = pa.FixedSizeListArray.from_arrays(flat, len(sums)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:3], pa.array(n, pa.int64()), evidence], names=["doc_id", "row", "source", "trigrams", "evidence"]
                )

    rows = docs.select("doc_id", row_key().alias("row"), "source", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, source string, trigrams long, evidence array<double>")


def _shares(scores: str) -> str:
    """SQL: probabilities from an array of log scores."""
    lifted = f"transform({scores}, x -> exp(x - array_max({scores})))"
    return f"transform({lifted}, x -> x / aggregate({lifted}, 0D, (a, b) -> a + b))"


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id, declared, host, suffix`` from crawled pages (``url``, ``html``) whose path ends
    in the id of the document that was made of them. Of several pages the least values count."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    rows = pages.select(
        F.regexp_extract(path, r"([0-9]{1,18})([.][a-z]+)?/?$", 1).try_cast("long").alias("doc_id"),
        F.nullif(lang, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
    )
    by_document = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("declared").alias("declared"), F.min("host").alias("host"))
    return by_document.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([a-z]+)$", 1), F.lit("")))


def _placed(found: DataFrame, provenance: DataFrame | None) -> DataFrame:
    """``found`` with ``declared``, ``host`` and ``suffix``. A missing name becomes one of the
    row's own, so that rows without it do not meet in one task."""
    own = F.concat(F.lit(NONE), F.col("row").cast("string"))
    if provenance is None:
        found = found.withColumns({c: F.lit(None).cast("string") for c in ("declared", "host", "suffix")})
    else:
        facts = provenance.filter("doc_id is not null").withColumn("key", F.col("doc_id").cast("string")).drop("doc_id")
        found = found.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), own)).join(apart(facts), "key", "left")
    return found.withColumns({"host": F.coalesce("host", "source", own), "suffix": F.coalesce("suffix", own)})


def identify(docs: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """``doc_id, row, language, probability, text_language, accepted`` per row of ``docs``
    (``doc_id, text, lang, source``). ``provenance``: ``doc_id, declared, host, suffix``, one
    row a document; the source stands in for a missing host."""
    small_batches(docs.sparkSession)
    names, table = fit(docs)
    if not names:
        none = F.lit(None).cast("string")
        return docs.select(
            "doc_id", row_key().alias("row"), none.alias("language"), F.lit(None).cast("double").alias("probability"),
            none.alias("text_language"), F.lit(False).alias("accepted"),
        )
    langs = F.array(*(F.lit(x) for x in names))
    named = lambda share: F.element_at(langs, F.array_position(share, F.array_max(share)).cast("int"))
    found = _text_evidence(docs, table).withColumn("text_share", F.expr(_shares("evidence")))
    rows = cut_lineage(_placed(found, provenance))

    telling = rows.filter("trigrams > 0")
    sums = [F.sum(F.col("text_share")[k]).alias(f"s{k}") for k in range(len(names))]
    sum_of = lambda name: F.array(*(F.col(f"s{k}") for k in range(len(names)))).alias(name)
    whole = [x or 0.0 for x in telling.agg(*sums).first()]
    share = [(x + 1) / (sum(whole) + len(whole)) for x in whole]
    grouped = lambda by: telling.filter(~F.col(by).startswith(NONE)).groupBy(by).agg(*sums).select(by, sum_of(f"{by}_sum"))
    # As many rows as there are names of declared languages.
    joined = rows.join(apart(grouped("host")), "host", "left").join(apart(grouped("suffix")), "suffix", "left")
    declared_key = F.coalesce("declared", F.concat(F.lit(NONE), F.col("row").cast("string")))
    joined = joined.withColumn("declared", declared_key).join(apart(grouped("declared")), "declared", "left")

    # Sums without the row itself.
    others = "zip_with({0}, text_share, (s, own) -> greatest(s - own, 0D))"

    def level(sums: str, above: str) -> str:
        raised = f"transform({others.format(sums)}, (s, k) -> s + {PRIOR_ROWS}D * {above}[k])"
        return f"coalesce(transform({raised}, s -> s / aggregate({raised}, 0D, (a, b) -> a + b)), {above})"

    joined = joined.withColumns({"all_sum": F.array(*map(F.lit, whole)), "all_prior": F.array(*map(F.lit, share))})
    joined = joined.withColumn("suffix_prior", F.expr(level("suffix_sum", "all_prior")))
    joined = joined.withColumn("host_prior", F.expr(level("host_sum", "suffix_prior")))
    # P(declared | language); a missing declaration says nothing.
    said = f"coalesce(zip_with({others.format('declared_sum')}, all_sum, (s, n) -> (s + 0.5D) / (n + 1D)), transform(all_sum, x -> 1D))"
    joined = joined.withColumn("said", F.expr(said))
    scores = "transform(evidence, (e, k) -> e + ln(host_prior[k]) + ln(said[k]))"
    fused = joined.withColumn("share", F.expr(_shares(f"({scores})")))
    has_letters = F.col("trigrams") > 0
    # The evidence is tempered by length; this is the mean again.
    known = F.array_max("evidence") * (1 / TRUST + 1 / F.greatest("trigrams", F.lit(1))) > BACKGROUND
    return fused.select(
        "doc_id",
        "row",
        F.when(has_letters, named(F.col("share"))).alias("language"),
        F.when(has_letters, F.array_max("share")).alias("probability"),
        F.when(has_letters, named(F.col("text_share"))).alias("text_language"),
        (has_letters & (F.array_max("share") >= LEAST) & known).alias("accepted"),
    )


def accepted(docs: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""
    # Written first: a filter on what is computed here would be pushed below the steps that
    # share its parts, and compute them over and over.
    decided = cut_lineage(identify(docs, provenance).select(F.col("row").alias("__row"), "accepted"))
    keep = decided.filter("accepted").select("__row").distinct()
    return docs.withColumn("__row", row_key()).join(keep, "__row", "left_semi").drop("__row")
