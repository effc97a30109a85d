"""Plain readings of the contracts, text by text, to compare the operators with."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SECRETS = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]


def base(text: str | None, rules: list) -> list[tuple[str, int, int]]:
    found = [(kind, *m.span()) for kind, p, ok in rules for m in re.finditer(p, text or "") if ok(m)]
    kinds = [r[0] for r in rules]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def span_row(text: str | None, rules: list) -> tuple:
    found = base(text, rules)
    return *(sum(k == kind for k, _, _ in found) for kind, _, _ in rules), sha(listed(found))


def repetition(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    in_repeat = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 3)} if len(words) < 3000 else None
    if in_repeat is None:
        from collections import Counter

        n = Counter(windows)
        in_repeat = {j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 3)}
    failed = len(words) < 50 or 100 * len(in_repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(in_repeat), failed


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered_words(text: str | None) -> list[str]:
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(texts: dict, items: list[tuple]) -> dict:
    known: dict[tuple, set] = {}
    for item, text in items:
        w = lowered_words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            known.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    sizes = {len(w) for w in known}
    out = {}
    for doc, text in texts.items():
        w, hit, named = lowered_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := known.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    named |= found
        out[doc] = (len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def token_ids(texts: list[str | None], name: str) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
