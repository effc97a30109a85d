"""Byte-level BPE encoding and decoding with content-defined chunk reuse (operator 3).

Texts are cut where a rolling hash of the last ``WINDOW`` bytes says so, so equal passages
give equal chunks wherever they stand. Three narrow passes over the texts:

1. chunk hashes alone are counted; the ones that occur twice or more set a bit in a bitmap of
   fixed size (``BITS``), which is broadcast;
2. chunks with a set bit, once a task, are shuffled by hash and each is encoded once;
3. every other chunk occurs once and is encoded where it stands. A text without shared chunks
   is finished there and then; of the others the pieces go on: ids or a chunk's hash.

Pieces are joined with the encoded chunks and put together by document. A join of pieces may
cut through a token, so it is repaired: the window around it grows on both sides to a place
where the tokenizer's pre-tokenizer cuts in any context (a blank before a visible character),
is decoded and encoded again; what lies beyond agrees exactly. Over a chunk without such a
place the window grows on. A collision of bits only makes a chunk take the longer way.

Defined cases: null and empty texts have no ids; texts with an added token's string are one
chunk, encoded whole; repeated rows and null ids are rows like any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import _BYTE, _powers, mix, small_batches
from lorekeep.llm.pieces import CHARACTER, ID, MARK, Pieces, cut_signs, pieces
from lorekeep.session import cut_lineage

WINDOW = 32
# A cut where this many low bits of the hash are 0, but not within LEAST bytes of the last.
CUT_BITS = 10
LEAST = 256
# Size of the bitmap of shared chunks: 2 MB.
BITS = 1 << 24

# A blank before a visible character; bytes that may begin white space beyond ASCII are left out.
_VISIBLE = rb"\x21-\x7e\xc3-\xe0\xe4-\xff"
_SAFE = re.compile(rb" (?=[" + _VISIBLE + rb"])")
_UNSAFE = re.compile(rb" (?![" + _VISIBLE + rb"])")
_SPLIT = re.compile(rb" (?=[" + _VISIBLE + MARK + rb"])")


def cuts(data: bytes) -> list[int]:
    """Where chunks end, the end of ``data`` included."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    rolling = mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])
    at = np.flatnonzero(rolling & np.uint64((1 << CUT_BITS) - 1) == 0) + WINDOW
    at = at[at < n]
    # Not inside a character.
    at = at[(raw[at] & 0xC0) != 0x80]
    out, last = [], 0
    for k in at.tolist():
        if k - last >= LEAST:
            out.append(k)
            last = k
    return [*out, n]


class Codec:
    """A byte-level tokenizer of the library, with its vocabulary as bytes."""

    def __init__(self, path: str):
        self.known: Pieces = pieces(path, lower=False, blank="Ġ")
        tokenizer = self.known.tokenizer
        to_byte = {c: b for b, c in enumerate(CHARACTER)}
        added = tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        self.bytes: list[bytes] = [b""] * tokenizer.get_vocab_size()
        for token, k in tokenizer.get_vocab().items():
            self.bytes[k] = token.encode() if k in added else bytes(to_byte[c] for c in token)

    def has_added(self, data: bytes) -> bool:
        return any(t in data for t in self.added)

    def chunks(self, data: bytes) -> list[bytes]:
        if self.has_added(data):
            return [data]
        ends = cuts(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, data: bytes) -> bytes:
        """Ids of a whole text, or of a part that starts and ends at safe places."""
        if not data:
            return b""
        if self.has_added(data) or MARK in data:
            return self.known.whole(data.decode()).tobytes()
        raw = np.frombuffer(data, np.uint8)
        [marked] = cut_signs(raw, np.array([0, len(raw)]), b" " + MARK)
        words = _SPLIT.split(marked) if _UNSAFE.search(data) else marked.split(b" ")
        # No blank stands before the first one.
        words[0] = MARK + words[0]
        self.known.learn(set(words))
        return b"".join(map(self.known.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, ID).tolist()))

    def encode_chunk(self, data: bytes) -> tuple[bytes, int, int]:
        """Ids of a chunk by itself; how many of them stand before its first and after its
        last safe place, (-1, -1) if it has none."""
        first = _SAFE.search(data)
        if not first or self.has_added(data):
            return self.encode(data), -1, -1
        last = data.rfind(b" ")
        while not _SAFE.match(data, last):
            last = data.rfind(b" ", 0, last)
        head, body, tail = (self.encode(x) for x in (data[: first.start()], data[first.start() : last], data[last:]))
        return head + body + tail, len(head) // 4, len(tail) // 4

    def join(self, parts: list[tuple[bytes, int, int]]) -> bytes:
        """Ids of the text whose chunks have these ids, with the joins repaired."""
        out: list[bytes] = []
        window = b""
        for k, (ids, head, tail) in enumerate(parts):
            if len(parts) == 1:
                return ids
            if head < 0:
                window += self.decode(ids)
                continue
            begin, end = 4 * head, len(ids) - 4 * tail
            if k:
                out.append(self.encode(window + self.decode(ids[:begin])))
                begin_kept = begin
            else:
                begin_kept = 0
            if k == len(parts) - 1:
                out.append(ids[begin_kept:])
                window = b""
            else:
                out.append(ids[begin_kept:end])
                window = self.decode(ids[end:])
        if window:
            out.append(self.encode(window))
        return b"".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _bit(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") % BITS


def _map(df: DataFrame, schema: str, function) -> DataFrame:
    """``function`` maps rows of ``df`` (tuples) to an iterator of rows of ``schema``."""
    kind = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = list(function(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def shared_bitmap(docs: DataFrame, path: str) -> np.ndarray:
    """The bits of all chunk hashes that occur twice or more, from counts over all texts."""

    def hashes(rows):
        found: dict[bytes, int] = {}
        for (text,) in rows:
            for chunk in codec(path).chunks((text or "").encode()):
                key = chunk_hash(chunk)
                found[key] = found.get(key, 0) + 1
        return ((key, _bit(key), n) for key, n in found.items())

    counted = _map(docs.select("text"), "hash binary, bit int, n long", hashes).groupBy("hash").agg(
        F.sum("n").alias("n"), F.first("bit").alias("bit")
    )
    words = counted.filter("n > 1").groupBy(F.expr("bit div 8").alias("word")).agg(F.bit_or(F.expr("shiftleft(1, bit % 8)")).alias("bits"))
    # At most BITS / 8 rows, whatever the input: a byte of the bitmap each.
    bitmap = np.zeros(BITS // 8, np.uint8)
    for batch in words.select(F.col("word").cast("int"), F.col("bits").cast("int")).toArrow().to_batches():
        bitmap[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return bitmap


def encode(docs: DataFrame, path: str, finish, schema: str) -> DataFrame:
    """``finish(codec, ids)`` for every row of ``docs``: ``doc_id`` and the columns of
    ``schema``. ``ids`` are little-endian unsigned 32-bit integers; see ``encode_ids``."""
    spark = docs.sparkSession
    small_batches(spark)
    bitmap = spark.sparkContext.broadcast(shared_bitmap(docs, path))

    def is_shared(key: bytes) -> bool:
        bit = _bit(key)
        return bool(bitmap.value[bit >> 3] >> (bit & 7) & 1)

    def shared_chunks(rows):
        found = {}
        for (text,) in rows:
            chunks = codec(path).chunks((text or "").encode())
            if len(chunks) > 1:
                for chunk in chunks:
                    key = chunk_hash(chunk)
                    if key not in found and is_shared(key):
                        found[key] = chunk
            elif chunks and is_shared(key := chunk_hash(chunks[0])):
                found[key] = chunks[0]
        return found.items()

    def encode_chunks(rows):
        return ((key, *codec(path).encode_chunk(chunk)) for key, chunk in rows)

    distinct = _map(docs.select("text"), "hash binary, chunk binary", shared_chunks).groupBy("hash").agg(F.first("chunk").alias("chunk"))
    encoded = cut_lineage(_map(distinct, "hash binary, part_ids binary, head int, tail int", encode_chunks))

    names = [f.name for f in T.StructType.fromDDL(schema)]
    none = (None,) * len(names)
    counter = [0]

    def pieces_of(rows):
        c, base = codec(path), TaskContext.get().partitionId() << 36
        for doc, text in rows:
            counter[0] += 1
            row = base + counter[0]
            data = (text or "").encode()
            runs: list[tuple[bytes | None, bytes]] = []
            for chunk in c.chunks(data):
                key = chunk_hash(chunk)
                if is_shared(key):
                    runs.append((key, b""))
                elif runs and runs[-1][0] is None:
                    runs[-1] = None, runs[-1][1] + chunk
                else:
                    runs.append((None, chunk))
            if not any(key for key, _ in runs):
                yield row, doc, None, None, None, None, None, *finish(c, c.encode(data))
                continue
            for k, (key, chunk) in enumerate(runs):
                part = (None, None, None) if key else c.encode_chunk(chunk)
                yield row, doc, k, key, *part, *none

    columns = "row long, doc_id long, place int, hash binary, part_ids binary, head int, tail int, " + schema
    staged = cut_lineage(_map(docs.select(F.col("doc_id").cast("long"), "text"), columns, pieces_of))
    done = staged.filter("place is null").select("doc_id", *names)
    part = F.struct("place", "part_ids", "head", "tail").alias("part")
    own = staged.filter("place is not null and hash is null").select("row", "doc_id", part)
    referred = staged.filter("hash is not null").select("row", "doc_id", "place", "hash").join(encoded, "hash").select("row", "doc_id", part)
    whole = own.unionAll(referred).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("part").alias("parts"))

    def assemble(rows):
        c = codec(path)
        for doc, parts in rows:
            parts = sorted((p["place"], p["part_ids"], p["head"], p["tail"]) for p in parts)
            yield doc, *finish(c, c.join([p[1:] for p in parts]))

    joined = _map(whole.select("doc_id", "parts"), "doc_id long, " + schema, assemble)
    return done.unionAll(joined)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids as an array."""
    return encode(docs, path, lambda c, ids: (np.frombuffer(ids, ID).tolist(),), "ids array<long>")


def decode_ids(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(rows):
        return ((doc, codec(path).decode(np.array(i, ID).tobytes()).decode("utf-8", "replace")) for doc, i in rows)

    small_batches(ids.sparkSession)
    return _map(ids.select("doc_id", "ids"), "doc_id long, text string", run)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the count of ids, their hash, and the hash of the text they decode to."""

    def finish(c: Codec, ids: bytes):
        text = c.decode(ids).decode("utf-8", "replace").encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode(docs, path, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
