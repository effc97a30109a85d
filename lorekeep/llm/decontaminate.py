"""Benchmark decontamination by word windows (operator 6).

Windows of the benchmark's items (``WINDOW`` words; a shorter item is one window) are hashed
and broadcast; every text is scanned by rolling window hashes in numpy and a hit is verified
word by word. Words are runs of ASCII letters and digits and of anything beyond ASCII, ASCII
letters lower-cased. The broadcast is bounded by ``MAX_WINDOWS``; a larger benchmark is joined
with the texts' windows by their hash instead, with the same result.

Defined cases: a null text has no words and no hit; an item without words has no window; items
with equal windows are all named; an item without an id is named ``null``; repeated rows of
either table change nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import LOWER, Texts, byte_table, covered, map_texts, row_key, span_hashes, texts_of, windows
from lorekeep.session import apart, cut_lineage

# Fixed values of the contract.
WINDOW = 13
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# Windows that are broadcast at most, about 150 bytes each.
MAX_WINDOWS = 500_000

_WORD = ~byte_table(NOT_WORD)
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "n_words long, n_hit long, items array<string>"


def words(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


def item_windows(text: str | None) -> list[list[bytes]]:
    w = words(text)
    return [w[k : k + WINDOW] for k in range(max(1, len(w) - WINDOW + 1))] if w else []


class Windows:
    """Windows by hash; each with its words and the items that have it."""

    def __init__(self, items: list[tuple[str, str | None]]):
        by: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for w in item_windows(text):
                by[tuple(w)].add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        for length in {len(w) for w in by}:
            entries: dict[int, list] = defaultdict(list)
            for w, found in by.items():
                if len(w) == length:
                    entries[window_hash(w)].append((w, found))
            self.by_length[length] = np.array(sorted(entries), np.uint64), entries


def _hashed(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[t.data]
    starts, ends, owner = t.spans(_WORD[data])
    return data, starts, ends, owner, span_hashes(data, starts, ends)


def window_hash(window: tuple[bytes, ...]) -> int:
    t = next(texts_of(pa.array([b" ".join(window).decode()])))
    _, _, _, owner, hashes = _hashed(t)
    return int(windows(hashes, owner, len(window))[0][0])


def scan(t: Texts, known: Windows) -> dict:
    """Word count, hit words and items of some texts."""
    data, starts, ends, owner, hashes = _hashed(t)
    hit_from, hit_to = [], []
    items: list[set[str]] = [set() for _ in range(len(t))]
    for length, (sorted_hashes, entries) in known.by_length.items():
        found, at = windows(hashes, owner, length)
        place = np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)
        for k in np.flatnonzero(sorted_hashes[place] == found):
            first = int(at[k])
            for window, named in entries[int(found[k])]:
                if all(data[starts[first + n] : ends[first + n]].tobytes() == w for n, w in enumerate(window)):
                    hit_from.append(first)
                    hit_to.append(first + length)
                    items[owner[first]] |= named
    hit = covered(len(hashes), np.array(hit_from, np.int64), np.array(hit_to, np.int64))
    return {
        "n_words": np.bincount(owner, minlength=len(t)),
        "n_hit": np.bincount(owner[hit], minlength=len(t)),
        "items": [sorted(x) for x in items],
    }


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``n_words``, ``n_hit`` (words inside an
    occurrence of a window) and ``items`` (sorted ids of the items that occur)."""
    items = _items(benchmark)
    # Words are at most half the bytes of a text, so this bounds the windows from above.
    bound = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if bound > max_windows:
        return _joined_hits(docs, items, carry)
    known = Windows([(r.item, r.text) for r in items.collect()])
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return map_texts(docs, HITS, lambda t: scan(t, shared.value), carry)


def _joined_hits(docs: DataFrame, items: DataFrame, carry: list[str] | None) -> DataFrame:
    """The same by a join on the window's hash: every window of the texts that has the hash of
    a benchmark window is verified and marks its words."""
    lengths = "windows array<struct<hash: long, first: int, words: string>>"
    by_item = map_texts(items.filter("text is not null"), lengths, lambda t: {"windows": _listed(t, None)}, ["item"])
    known = by_item.select("item", F.explode("windows").alias("w")).select("item", "w.hash", "w.words").distinct()
    sizes = [r[0] for r in known.select(F.size(F.split("words", " "))).distinct().collect()]
    known = cut_lineage(known.groupBy("hash", "words").agg(F.collect_set("item").alias("named")))
    keyed = docs.withColumn("__row", row_key())
    texts = keyed.groupBy("__row").agg(F.first("text").alias("text"))
    listed = map_texts(texts, "n_words long, " + lengths, lambda t: _counted(t, sizes), ["__row"])
    listed = cut_lineage(listed)
    found = (
        listed.select("__row", F.explode("windows").alias("w"))
        .select("__row", "w.hash", "w.first", "w.words")
        .join(apart(known), ["hash", "words"])
        .groupBy("__row")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.expr("first + size(split(words, ' ')) - 1"))))))
            .cast("long")
            .alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("named")))).alias("items"),
        )
    )
    counts = listed.select("__row", "n_words").join(found, "__row", "left").select(
        "__row",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "n_hit", "items")]
    return keyed.select(*kept, "__row").join(apart(counts), "__row").select(*kept, "n_words", "n_hit", "items")


def _counted(t: Texts, sizes: list[int]) -> dict:
    _, _, _, owner, _ = _hashed(t)
    return {"n_words": np.bincount(owner, minlength=len(t)), "windows": _listed(t, sizes)}


def _listed(t: Texts, sizes: list[int] | None) -> list[list[dict]]:
    """Per text its windows of the given sizes; without sizes, those of a benchmark item."""
    data, starts, ends, owner, hashes = _hashed(t)
    first_word = np.searchsorted(owner, np.arange(len(t) + 1))
    out: list[list[dict]] = [[] for _ in range(len(t))]
    n = np.diff(first_word)
    for size in set(np.minimum(n[n > 0], WINDOW).tolist()) if sizes is None else sizes:
        found, at = windows(hashes, owner, size)
        for h, k in zip(found.view(np.int64).tolist(), at.tolist(), strict=True):
            if sizes is None and size != min(n[owner[k]], WINDOW):
                continue
            text = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(k, k + size)).decode()
            out[owner[k]].append({"hash": h, "first": k - int(first_word[owner[k]]), "words": text})
    return out


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, with all their columns as they were, also those
    named like the ones that are added in between."""
    added = {field.split()[0] for field in HITS.split(", ")}
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in added}
    clean = benchmark_hits(docs.withColumnsRenamed(aside), benchmark).filter(~contaminated())
    return clean.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
