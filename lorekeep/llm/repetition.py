"""Quality rules by repetition coverage (operator 10).

Word windows of several lengths and lines are hashed by one rolling hash per text; a rule
measures the share of a text's word characters inside windows, or lines, that occur more
than once in it. One narrow map in numpy, no shuffle; a step holds about a megabyte of text.

Defined cases: a null or empty text, and one of white space alone, has no words, all counts
and shares 0 and fails the word count. Repeated rows are judged alike, extra columns of the
input stay unless a result column has their name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lorekeep.llm.common import (
    NOT_SPACE,
    Texts,
    byte_table,
    covered,
    map_texts,
    occurred_before,
    repeated,
    span_hashes,
    windows,
)

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
# Largest share of word characters inside repeated windows of so many words, and inside
# lines that repeat an earlier one. Longer windows repeat less by chance.
WINDOW_LIMITS = {5: 0.45, 6: 0.44, 7: 0.43, 8: 0.42, 9: 0.41, 10: 0.40}
LINE_LIMIT = 0.45

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", window_share double, line_share double, base_failed boolean, kept boolean"
_SYMBOL = byte_table(SYMBOLS)


def measure(t: Texts) -> dict[str, np.ndarray]:
    """All columns of the operator for some texts."""
    inside = NOT_SPACE[t.data]
    starts, ends, owner = t.spans(inside)
    words = span_hashes(t.data, starts, ends)
    # A code point is its first byte.
    first = np.concatenate([[0], np.cumsum(((t.data & 0xC0) != 0x80) & inside)])
    chars = first[ends] - first[starts]
    size, n = len(t), len(words)
    out = {"n_words": np.bincount(owner, minlength=size), "word_chars": np.bincount(owner, chars, size).astype(np.int64)}
    out["n_symbols"] = t.per_text(_SYMBOL[t.data])

    line_start, line_end, line_owner = t.spans(t.data != ord("\n"))
    upto = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = upto[1] > upto[0]
    line_start, line_end, line_owner, first_word, end_word = (x[full] for x in (line_start, line_end, line_owner, *upto))
    later = occurred_before(line_owner, span_hashes(t.data, line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=size)
    in_lines = covered(n, first_word[later], end_word[later])

    total = np.maximum(out["word_chars"], 1)
    share = lambda flags: np.bincount(owner, chars * flags, size) / total
    out["line_share"] = share(in_lines)
    at = _repeats(words, owner, 3, None)
    out["n_repeat_words"] = np.bincount(owner[covered(n, at, at + 3)], minlength=size)
    out["window_share"], bad = np.zeros(size), out["line_share"] > LINE_LIMIT
    for length, limit in WINDOW_LIMITS.items():
        at = _repeats(words, owner, length, at)
        part = share(covered(n, at, at + length))
        out["window_share"], bad = np.maximum(out["window_share"], part), bad | (part > limit)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def _repeats(words: np.ndarray, owner: np.ndarray, length: int, among: np.ndarray | None) -> np.ndarray:
    """First positions of the windows that occur twice or more in their text. A window can
    repeat only where a shorter one (``among``) does."""
    hashes, at = windows(words, owner, length)
    if among is not None:
        keep = np.isin(at, among, assume_unique=True)
        hashes, at = hashes[keep], at[keep]
    return at[repeated(hashes + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the counts, ``window_share`` (largest over the
    window lengths), ``line_share``, ``base_failed`` and ``kept``."""
    return map_texts(docs, SCHEMA, measure, carry)
