"""What the operators share: batches of texts as bytes, word bounds and hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Bytes of text that one step of numpy handles; a single longer text is a step of its own.
STEP_BYTES = 1 << 20
# ASCII white space between words.
SPACES = b"\x20\t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def row_key() -> Column:
    """A key of what a row says: equal for repeated rows, so that facts about a row can be
    joined back even where ``doc_id`` is null or repeated with other texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("text", F.lit("\0")))


@dataclass
class Texts:
    """Some texts of a batch as one buffer of UTF-8, and the same texts as a column."""

    data: np.ndarray
    offsets: np.ndarray
    column: pa.Array

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every maximal run of flagged bytes."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def texts_of(column: pa.Array) -> Iterator[Texts]:
    """The texts of a column (null: empty), a step of about ``STEP_BYTES`` at a time."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Texts(buffer[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], column.slice(at, to - at))
        at = to


def map_texts(docs: DataFrame, added: str, function: Callable[[Texts], dict], carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) and the ones that ``function`` makes
    from its texts, described by the DDL ``added``. Columns with a name of the added ones
    give way. A narrow map."""
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(added)
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new.names]
    docs = docs.select(*kept, F.col("text").alias("__text"))
    types = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in texts_of(batch.column(len(kept))):
                rows, found = batch.slice(at, len(texts)), function(texts)
                at += len(texts)
                columns = [pa.array(found[n], kind) for n, kind in zip(new.names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*kept, *new.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *new.fields]))


# Bytes of a bitmap in one row of a shuffle.
BITMAP_ROW = 1 << 12


def _bitmap_rows(bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bitmap as rows of ``BITMAP_ROW`` bytes, a few at a time, those without any bit left out."""
    rows = bitmap.reshape(-1, min(BITMAP_ROW, len(bitmap)))
    found = np.flatnonzero(rows.any(axis=1))
    for k in range(0, len(found), 64):
        at = found[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([rows[j].tobytes() for j in at], pa.binary())], names=["row", "bits"])


def seen_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size (a power of two) with the bit of every key (a long, the first
    column of ``keys``) set. Tasks set bits, and join what they have set; the driver gets a
    few thousand binary rows at most, whatever the input."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            bit = np.unique(batch.column(0).drop_null().to_numpy() % bits)
            np.bitwise_or.at(bitmap, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
        yield from _bitmap_rows(bitmap)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            _set_rows(bitmap, batch)
        yield from _bitmap_rows(bitmap)

    schema = "row int, bits binary"
    joined = keys.mapInArrow(mark, schema).repartition("row").mapInArrow(join, schema)
    bitmap = np.zeros(bits // 8, np.uint8)
    for batch in joined.toArrow().to_batches():
        _set_rows(bitmap, batch)
    return bitmap


def _set_rows(bitmap: np.ndarray, batch: pa.RecordBatch) -> None:
    for row, part in zip(batch.column(0).to_pylist(), batch.column(1)):
        part = np.frombuffer(part.as_buffer(), np.uint8)
        bitmap[row * len(part) : (row + 1) * len(part)] |= part


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the keys (int64) whose bit is set."""
    bit = keys % (8 * len(bitmap))
    return bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def byte_table(members: bytes | range) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


NOT_SPACE = ~byte_table(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UNDO = np.uint64(pow(_BASE, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, kept between steps."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((np.uint64(_BASE), _UNDO)):
            steps = np.full(max(n, STEP_BYTES + 1), base)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: a rolling polynomial over random byte
    values, taken as the difference of two prefix sums and moved to position 0."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every run of ``size`` words within one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(total[at]), at


def repeated(values: np.ndarray) -> np.ndarray:
    """Flags of the values that occur more than once."""
    more = np.zeros(len(values), bool)
    if len(values):
        order = np.argsort(values)
        same = values[order[1:]] == values[order[:-1]]
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
    return more


def occurred_before(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Flags of the values that occur earlier in the same text."""
    later = np.zeros(len(values), bool)
    if len(values):
        order = np.lexsort((values, owner))
        o, v = owner[order], values[order]
        later[order[1:]] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    return later


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of ``n`` positions that lie in one of the ranges."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0
