"""Token ids in a packed file format (operator 2).

``write_ids`` encodes every text, appends an end id and writes the ids in ascending order of
``doc_id`` as fixed-width numbers of the fewest bits that the vocabulary needs. A file is a
Parquet file of segments; a segment holds whole documents, about ``SEGMENT`` ids, and is one
row: document ids and where each ends, the byte offset of every block of ``BLOCK`` ids, and the
packed blocks. Blocks start on 64-bit words, so any range of ids is read by unpacking only the
blocks it touches, with a few numpy operations. Files are written through Spark's committer,
so a lost executor leaves no half file; they need no store that Python can open.

The texts are shuffled once, by ranges of ``doc_id`` (then text and a random number, so that
one id may hold any share of the rows), and sorted within a task; ids never move again. The
position of a document among all ids follows from the sizes of the ranges, one row each.

Defined cases: a null or empty text has the end id alone; a null ``doc_id`` comes first; rows
of equal ``doc_id`` are ordered by text; an empty table gives no segment.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import Texts, small_batches, texts_of
from lorekeep.llm.pieces import ID, Pieces, cut_signs, pieces

BLOCK = 4096
SEGMENT = 1 << 19
SEGMENTS = (
    "shard int, segment int, bits int, n_ids long, doc_ids array<long>, doc_ends array<long>, "
    "block_offsets array<long>, blocks binary"
)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as numbers of ``bits`` bits. 64 of them fill ``bits`` 64-bit words; the end is
    filled up with zeros."""
    rows = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 64)
    words = np.zeros((len(rows), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed data."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        rows[:, k] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            rows[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    return (rows & mask).astype(ID).ravel()[:n]


def unpack_range(segment: dict, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment, from the blocks they lie in alone."""
    if first >= last:
        return np.zeros(0, ID)
    a, b = first // BLOCK, -(-last // BLOCK)
    offsets = [*segment["block_offsets"], len(segment["blocks"])]
    part = segment["blocks"][offsets[a] : offsets[b]]
    return unpack(part, segment["bits"], min(last, segment["n_ids"]) - a * BLOCK)[first - a * BLOCK :]


def _encoded(t: Texts, known: Pieces) -> Iterator[bytes]:
    """The ids of every text. White space only separates words for this tokenizer, so what
    stands between ASCII white space is a piece."""
    marked = cut_signs(t.data, t.offsets, b" ")
    for k, (a, b) in enumerate(zip(t.offsets, t.offsets[1:])):
        # Added tokens, such as <|startoftext|>, are looked up before anything else.
        if b"<|" in marked[k]:
            marked[k] = t.data[a:b].tobytes()
    split = [m.split() for m in marked]
    known.learn(set().union(*split))
    get = known.known.__getitem__
    return (b"".join(map(get, words)) for words in split)


def _segment(shard: int, number: int, bits: int, docs: list, ends: list[int], ids: np.ndarray) -> dict:
    block_bytes = bits * BLOCK // 8
    return {
        "shard": shard, "segment": number, "bits": bits, "n_ids": len(ids), "doc_ids": docs, "doc_ends": ends,
        "block_offsets": [k * block_bytes for k in range(-(-len(ids) // BLOCK))], "blocks": pack(ids, bits),
    }


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``) to ``folder``/ids, and where each range
    of documents starts among all ids to ``folder``/starts. ``tokenizer``: a file whose
    pre-tokenizer drops white space and whose normalizer lower-cases."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = bits_for(max(pieces(tokenizer, lower=True, blank=None).tokenizer.get_vocab_size(), end_id + 1))
    tail = np.array([end_id], ID).tobytes()
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("bits", pa.int32()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
                        ("block_offsets", pa.list_(pa.int64())), ("blocks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, number = pieces(tokenizer, lower=True, blank=None), TaskContext.get().partitionId(), 0
        names: list = []
        ends: list[int] = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            docs_left = iter(batch.column(0).to_pylist())
            for t in texts_of(batch.column(1)):
                for ids in _encoded(t, known):
                    doc = next(docs_left)
                    held += (ids, tail)
                    size += (len(ids) + len(tail)) // len(tail)
                    names.append(doc)
                    ends.append(size)
                    if size >= SEGMENT:
                        row = _segment(shard, number, bits, names, ends, np.frombuffer(b"".join(held), ID))
                        yield pa.RecordBatch.from_pylist([row], schema)
                        names, ends, held, size, number = [], [], [], 0, number + 1
        if names:
            row = _segment(shard, number, bits, names, ends, np.frombuffer(b"".join(held), ID))
            yield pa.RecordBatch.from_pylist([row], schema)

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text"]
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        shards, "doc_id", F.xxhash64("text"), F.rand(7)
    )
    spread.sortWithinPartitions(*order).mapInArrow(run, SEGMENTS).write.parquet(os.path.join(folder, "ids"))
    sizes = spark.read.parquet(os.path.join(folder, "ids")).groupBy("shard", "segment").agg(F.sum("n_ids").alias("n_ids"))
    # One row for each segment of about half a million ids, by shard first.
    by_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shard_starts = by_shard.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(shard_starts, "shard")
    starts.select("shard", "segment", (F.col("shard_start") + F.col("within")).alias("start"), "n_ids").coalesce(1).write.parquet(
        os.path.join(folder, "starts")
    )


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``start``, how many ids come before them."""
    starts = spark.read.parquet(os.path.join(folder, "starts")).drop("n_ids")
    return spark.read.parquet(os.path.join(folder, "ids")).join(starts, ["shard", "segment"])


DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in (batch.slice(k, 1).to_pylist()[0] for k in range(len(batch))):
                ids = unpack(s["blocks"], s["bits"], s["n_ids"])
                ends = np.array(s["doc_ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["doc_ids"], pa.int64()), *(pa.array(x, pa.int64()) for x in (begins + s["start"], ends - begins, crc))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return read_segments(spark, folder).mapInArrow(run, DOCS)


def read_ids(spark: SparkSession, folder: str, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of all ids: the segments they lie in are found by
    ``start``, and only the blocks they touch are unpacked."""
    hit = read_segments(spark, folder).filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    parts = [
        unpack_range(s.asDict(), max(0, first - s.start), min(s.n_ids, last - s.start)) for s in hit.orderBy("start").collect()
    ]
    return np.concatenate([np.zeros(0, ID), *parts])
