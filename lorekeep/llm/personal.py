"""Personal data by bootstrapped contextual extraction (operator 5).

Base patterns find e-mail and network addresses, cards and phone numbers. They are the seeds:
the two words before a finding are a lexical pattern. Patterns and what they precede (tokens
with digits or ``@``) form a graph that Spark scores in ``ROUNDS`` rounds: a pattern is as good
as the share of all its occurrences in the corpus that precede known entities, an instance is
known by its patterns together. Instances of few digits (``FEW_DIGITS``: handles, local
addresses, but also the numbers of everyday text) are named like all others, and count as known
only by the share of their own occurrences that follow good patterns; else a common number that
once follows one would make every pattern before numbers good. Good patterns then name what no
base pattern finds.

Texts are read twice: once for findings and their contexts, once to count every occurrence of
the patterns (ordinary words after a pattern speak against it), of which a bitmap of fixed size
(``BITS``) tells which to count. The graph's rows are counted before they are joined.

Defined cases: null and empty texts have no spans; offsets are code points; equal spans are
one; repeated rows are judged alike; without seeds there are base spans only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import (
    LOWER,
    Texts,
    byte_table,
    has_bit,
    map_texts,
    row_key,
    seen_bits,
    small_batches,
    span_hashes,
    texts_of,
    windows,
)
from lorekeep.session import apart, cut_lineage

# Fixed values of the contract: base kinds in order.
KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
# A pattern counts with so many different instances, and is good from this share.
LEAST_INSTANCES = 3
LEAST_SHARE = 0.5
# Bits of the map of patterns to count: 2 MB.
BITS = 1 << 24

_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Matches start where a run of digits does: none can start within one, and long runs stay cheap.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may be an identifier: a token with a digit or an at sign.
_TOKEN = re.compile(r"[^\s\"'`,;:=<>(){}\[\]]*[0-9@][^\s\"'`,;:=<>(){}\[\]]*")
QUICK = "[0-9@]"
# Below so many digits an instance may be an everyday number.
FEW_DIGITS = 4
# Bytes between the last word of a pattern and what it precedes, at most.
GAP = 4
_LETTER = byte_table(bytes([*range(97, 123), *range(128, 256)]))
FOUND = "found array<struct<start: long, end: long, kind: string, instance: long, weak: boolean, pattern: long>>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\\\.[A-Za-z0-9-]+)+`` finds them, from the signs
    outwards: no long run of letters is tried from each of its places."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _patterns(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every pair of neighbouring words (runs of letters), where it ends, its text."""
    data = LOWER[t.data]
    starts, ends, owner = t.spans(_LETTER[data])
    hashes, at = windows(span_hashes(data, starts, ends), owner, 2)
    return hashes.view(np.int64), ends[at + 1], owner[at]


def _instance(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little", signed=True)


def findings(text: str) -> list[dict]:
    """Base spans and other tokens that may be identifiers, each with the pattern before it."""
    base = base_spans(text)
    begins = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, b, _ in base]).tolist() if base else []
    spans: list[tuple[int, int, str | None]] = list(base)
    for m in _TOKEN.finditer(text):
        # Not what a base span touches.
        k = bisect_right(begins, m.end() - 1)
        if k == 0 or reach[k - 1] <= m.start():
            spans.append((*m.span(), None))
    if not spans:
        return []
    spans.sort(key=lambda s: s[0])
    data = text.encode()
    t = next(texts_of(pa.array([text], pa.large_string())))
    hashes, ends, _ = _patterns(t)
    place = (lambda k: k) if len(data) == len(text) else np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).__getitem__
    out = []
    for start, end, kind in spans:
        at = int(place(start))
        k = int(np.searchsorted(ends, at, side="right")) - 1
        pattern = int(hashes[k]) if k >= 0 and at - ends[k] <= GAP else None
        token = text[start:end]
        weak = kind is None and len(_digits(token)) < FEW_DIGITS
        out.append({"start": start, "end": end, "kind": kind, "instance": _instance(token), "weak": weak, "pattern": pattern})
    return out


def _scan(t: Texts) -> dict:
    look = pc.match_substring_regex(t.column, QUICK).to_pylist()
    return {"found": [findings(t.column[k].as_py()) if x else [] for k, x in enumerate(look)]}


def _pattern_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: occurrences in all texts of the ``patterns`` (and of some whose bit
    is the same)."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(seen_bits(patterns.select(F.col("pattern").alias("key")), BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts_of(batch.column(0)):
                hashes, _, _ = _patterns(t)
                hit = hashes[has_bit(wanted.value, hashes)]
                if len(hit):
                    values, n = np.unique(hit, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())], names=["pattern", "total"])

    counted = docs.select("text").mapInArrow(count, "pattern long, total long")
    return counted.groupBy("pattern").agg(F.sum("total").alias("total"))


def good_patterns(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``pattern, share`` of the patterns that name personal data. ``found`` has a row for each
    finding: ``kind`` (null: unknown), ``instance``, ``weak``, ``pattern``."""
    edges = found.filter("pattern is not null").groupBy("pattern", "instance").agg(
        F.count("*").alias("n"), F.max(F.col("kind").isNotNull()).alias("seed")
    )
    enough = edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= LEAST_INSTANCES)
    edges = cut_lineage(edges.join(apart(enough.select("pattern")), "pattern"))
    totals = cut_lineage(_pattern_counts(docs, edges.select("pattern").distinct()).join(edges.select("pattern").distinct(), "pattern"))
    # Occurrences of weak instances, whatever precedes them.
    weak = found.filter("weak").groupBy("instance").agg(F.count("*").alias("occurs"))
    weak = cut_lineage(weak.join(edges.select("instance").distinct(), "instance", "left_semi"))
    score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        known = edges.join(apart(score), "instance")
        # An instance counts once for a pattern against its whole number of occurrences.
        share = known.groupBy("pattern").agg(F.sum(F.col("score") * F.col("n")).alias("good"))
        share = share.join(totals, "pattern").select("pattern", F.least(F.lit(1.0), F.col("good") / F.col("total")).alias("share"))
        share = cut_lineage(share)
        by_pattern = edges.join(apart(share), "pattern")
        unsure = F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))
        score = by_pattern.groupBy("instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(F.when(F.max("share") >= LEAST_SHARE, 1 - unsure).otherwise(0.0)).alias("score"),
            F.sum(F.when(F.col("share") >= LEAST_SHARE, F.col("n")).otherwise(0)).alias("behind"),
        )
        own = F.when(F.col("occurs").isNull(), 1.0).otherwise(F.col("behind") / F.col("occurs"))
        score = score.join(apart(weak), "instance", "left").select("instance", (F.col("score") * own).alias("score"))
    return share.filter(F.col("share") >= LEAST_SHARE)


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, row, spans`` per row of ``docs``: base spans and what good patterns name,
    ordered by start and kind."""
    keyed = docs.select("doc_id", row_key().alias("row"), "text")
    found = cut_lineage(map_texts(keyed, FOUND, _scan, ["doc_id", "row"]))
    # Repeated rows count as often as they do among all occurrences of a pattern.
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    good = good_patterns(docs, each)
    named = each.filter("kind is null").join(apart(good), "pattern").groupBy("row").agg(
        F.collect_set(F.struct("start", "end", F.lit("context").alias("kind"))).alias("more")
    )
    base = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["start"], f["end"], f["kind"]))
    whole = found.select("doc_id", "row", base.alias("base")).join(apart(named), "row", "left")
    order = F.array(*(F.lit(k) for k in KINDS))
    ranked = F.transform(
        F.concat("base", F.coalesce("more", F.array().cast("array<struct<start: long, end: long, kind: string>>"))),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return whole.select("doc_id", "row", spans.alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span (of overlapping ones, their union) replaced by its kind."""
    out, at, until = [], 0, -1
    for start, end, kind in sorted(spans):
        if start >= until:
            out += (text[at:start], f"[{kind.upper()}]")
        at = until = max(end, until)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all other columns stay."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    spans = personal_spans(docs).filter(F.size("spans") > 0).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__row", row_key()).join(apart(spans.dropDuplicates(["__row"])), "__row", "left")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            new = [masked(t, [(s["start"], s["end"], s["kind"]) for s in f]) if f else t for t, f in zip(texts, found)]
            kept = [pa.array(new, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    return joined.select(*columns, "__spans").mapInArrow(run, docs.schema)
