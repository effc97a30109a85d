"""Ids of text pieces, remembered between texts: a piece is encoded by the tokenizers library
the first time a worker meets it. Both operators that encode cut texts only at places where
the library's own pre-tokenizer always cuts, so joined pieces give the ids of the whole."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from lorekeep.llm.common import byte_table

# Pieces that a worker remembers at most, in two generations: when the younger one is full, it
# becomes the older one, and what has not been met since is forgotten.
MEMORY = 1 << 19
# Before a piece that no blank precedes.
MARK = b"\0"
ID = "<u4"
_SIGNS = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGN, _LETTER = byte_table(_SIGNS), byte_table(bytes([*range(65, 91), *range(97, 123)]))
# The second bytes of À-Ö, Ø-ö and ø-ÿ, after 0xC3.
_SECOND = byte_table(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))


def _characters() -> list[str]:
    """How byte-level vocabularies write each byte: a printable one as itself, the n-th other
    as code point 256 + n."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


CHARACTER = _characters()


def cut_signs(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> list[bytes]:
    """Texts with ``mark`` put between a Latin letter and an ASCII sign that follows it, where
    the pre-tokenizers cut in any context."""
    letter = _LETTER[data]
    letter[1:] |= _SECOND[data[1:]] & (data[:-1] == 0xC3)
    at = np.flatnonzero(letter[:-1] & _SIGN[data[1:]]) + 1
    marked = np.insert(data, np.repeat(at, len(mark)), np.tile(np.frombuffer(mark, np.uint8), len(at))).tobytes()
    ends = (offsets + len(mark) * np.searchsorted(at, offsets)).tolist()
    return [marked[a:b] for a, b in zip(ends, ends[1:])]


class Pieces:
    """``lower``: the tokenizer lower-cases; ``blank``: pieces without ``MARK`` are encoded
    with a leading blank, which the model writes so."""

    def __init__(self, path: str, *, lower: bool, blank: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower, self.blank = lower, blank
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID)

    def learn(self, pieces: set[bytes]) -> None:
        """Make sure that all ``pieces`` are known."""
        missing = [p for p in pieces if p not in self.known]
        if len(self.known) + len(missing) > MEMORY // 2:
            self.older, self.known = self.known, {}
            missing = list(pieces)
        hard = []
        for p in missing:
            if p in self.older:
                self.known[p] = self.older[p]
            elif not self._word(p):
                hard.append(p)
        texts = [p[1:].decode() if p[:1] == MARK else (" " if self.blank else "") + p.decode() for p in hard]
        for p, e in zip(hard, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            self.known[p] = array("I", e.ids).tobytes()

    def _word(self, piece: bytes) -> bool:
        """Learn a piece that is one Latin word: the model alone is enough."""
        word = piece.decode()
        if not _WORD.fullmatch(word):
            return False
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(CHARACTER.__getitem__, word.encode()))
        tokens = self.tokenizer.model.tokenize((self.blank or "") + word)
        self.known[piece] = array("I", [t.id for t in tokens]).tobytes()
        return True


_OPEN: dict[tuple, Pieces] = {}


def pieces(path: str, *, lower: bool, blank: str | None) -> Pieces:
    """The tokenizer at ``path``, loaded once a worker."""
    key = path, lower, blank
    if key not in _OPEN:
        _OPEN[key] = Pieces(path, lower=lower, blank=blank)
    return _OPEN[key]
