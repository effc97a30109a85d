"""Secret scans by assignment-aware lexing (operator 4).

Besides the base patterns, a text that names something sensitive is read as source or
configuration: ``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``name => 'literal'``, ``<name>literal</name>``, literals joined by ``+``. A name on the right
hand side stands for the literals it was given earlier in the text. A literal is scored by the
most sensitive name it reaches and by how random it looks. One narrow map, no shuffle.

Defined cases: null and empty texts have no spans; offsets are code points; repeated rows are
judged alike; of equal spans one stays; a found literal inside a base span is not repeated.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lorekeep.llm.common import Texts, map_texts

# Fixed values of the contract: base kinds in order, and the least length of a finding.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
# The same, for a quick look at a whole column.
QUICK_BASE = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA|[0-9a-f]{16}"""
QUICK_NAMES = r"(?i)pass|pwd|secret|token|key|cred|auth|private|signature"

# How sensitive a part, or two adjacent parts, of a name is.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "tokens": 0.9, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8,
    "signature": 0.6, "apikey": 1.0, "api key": 1.0, "access key": 1.0, "private key": 1.0, "signing key": 0.9,
    "encryption key": 0.9, "account key": 0.9, "client key": 0.8, "auth key": 0.9,
}
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|\.{3,}|^(true|false|none|null)$")
LEAST_SCORE = 0.5
SPANS = "spans array<struct<kind: string, start: long, end: long, score: double>>"

PAIR = re.compile(r"""(?<![\w.$-])([A-Za-z_$][\w.$-]*)["'`]?[ \t]*(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*""")
TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</")
QUOTED = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`''')
BARE = re.compile(r"""[^\s"'`,;#&<>(){}\[\]]+""")
USE = re.compile(r"(?:\$\{?|%\()?([A-Za-z_$][\w.$-]*)\}?(?:\)s)?")
PLUS = re.compile(r"[ \t]*\+[ \t]*(?:\\?\n[ \t]*)?")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in ASSIGN.finditer(text):
        if m.end() - m.start(2) >= ASSIGN_LENGTH:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_LENGTH:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def name_weight(name: str) -> float:
    """How sensitive an identifier is, by its parts in any of the usual spellings."""
    parts = [p.lower() for p in PART.findall(name)]
    return max((NAMES.get(p, 0.0) for p in [*parts, *map(" ".join, zip(parts, parts[1:]))]), default=0.0)


def literal_weight(value: str) -> float:
    """How random a literal looks: bits a character of its own distribution, the kinds of
    characters it mixes and its length; 0 for placeholders, references and short ones."""
    if len(value) < 8 or PLACEHOLDER.search(value) or re.search(r"\s", value) or "${" in value or "://" in value:
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (0.5 if kinds < 2 else 1.0)


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """Assigned name, the literals on its right hand side, the names used there."""
    for m in PAIR.finditer(text):
        literals, uses, at = [], [], m.end()
        while True:
            if q := QUOTED.match(text, at):
                literals.append(q.span(q.lastindex))
            elif q := BARE.match(text, at):
                if u := USE.fullmatch(q[0].rstrip(".")):
                    uses.append(u[1])
                literals.append((q.start(), q.start() + len(q[0].rstrip("."))))
            else:
                break
            at = q.end()
            if not (p := PLUS.match(text, at)):
                break
            at = p.end()
        if literals:
            yield m[1], literals, uses
    for m in TAG.finditer(text):
        yield m[1], [m.span(2)], []


def scored_literals(text: str) -> dict[tuple[int, int], float]:
    """Span of every literal with the best score among the names it reaches. A name on the right
    hand side stands for its last assignment before, so weights go from the last assignment to
    the first, each to those it uses: one step for each use, however long a chain is."""
    latest: dict[str, int] = {}
    assigned: list[tuple[list[tuple[int, int]], list[int]]] = []
    weights: list[float] = []
    for name, literals, uses in pairs(text):
        assigned.append((literals, [latest[u] for u in uses if u in latest]))
        weights.append(name_weight(name))
        latest[name] = len(assigned) - 1
    best: dict[tuple[int, int], float] = {}
    for n in range(len(assigned) - 1, -1, -1):
        if weight := weights[n]:
            literals, used = assigned[n]
            for u in used:
                weights[u] = max(weights[u], weight)
            for start, end in literals:
                best[start, end] = max(weight, best.get((start, end), 0.0))
    return {span: weight * literal_weight(text[slice(*span)]) for span, weight in best.items()}


def spans(text: str, lex: bool) -> list[tuple[str, int, int, float]]:
    found = [(*s, 1.0) for s in base_spans(text)]
    if lex:
        taken = sorted((s, e) for _, s, e, _ in found)
        # The furthest end of the base spans up to each one's start.
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for (start, end), score in scored_literals(text).items():
            before = bisect_right(starts, start)
            if score >= LEAST_SCORE and not (before and end <= ends[before - 1]):
                found.append(("literal", start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(t: Texts) -> dict[str, list]:
    named = pc.match_substring_regex(t.column, QUICK_NAMES)
    look = pc.or_(named, pc.match_substring_regex(t.column, QUICK_BASE)).to_pylist()
    out: list[list] = [[] for _ in range(len(t))]
    for k, lex in enumerate(named.to_pylist()):
        if look[k]:
            out[k] = [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.column[k].as_py(), lex)]
    return {"spans": out}


def find_secrets(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``spans``, ordered by start and kind."""
    return map_texts(docs, SPANS, _scan, carry)
