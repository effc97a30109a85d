"""Near-duplicate documents by an exact Jaccard join of word shingles (operator 9).

Documents with the same set of shingles are one class. Every class orders its set rarest
first, by a count sketch of all shingles (``BUCKETS`` counters, broadcast), and posts only the
prefix in which two sets of the wanted similarity must meet. Pairs that meet pass

* the length filter, ``|y| >= t |x|``;
* the positional filter: what is left after the first shared shingle suffices;
* the suffix filter: the parity bits of two sets differ in no more places than the sets do;
  256 bits are compared in the join, then twice as many bits as a set has shingles;

and are then verified once on the whole sets, which only classes in such pairs send.

Posting lists are never expanded to all pairs. First every member meets the list's least
class in ``ORDERS`` orders; verified links give components. Then, and that makes the join
exact, members outside a list's largest component meet the members of other components. So a
large group of near copies costs rows in proportion to its size, and no link that could join
two components is lost. Hot shingles, classes and components are pre-aggregated or joined
with one row a key, which adaptive execution splits.

Defined cases: words are separated by ASCII white space, A-Z lower-cased. Null texts and texts
without words have an empty set and are linked with nothing; fewer words than a shingle are
one shingle. Repeated rows are one class; a component without any ``doc_id`` has a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import (
    LOWER,
    NOT_SPACE,
    Texts,
    has_bit,
    mix,
    row_key,
    seen_bits,
    small_batches,
    span_hashes,
    texts_of,
    windows,
)
from lorekeep.llm.components import components
from lorekeep.session import apart, cut_lineage

# Fixed values of the contract of operator 9; other callers name their own.
SHINGLE = 3
SIMILARITY = (90, 100)
# Counters of the sketch, and of one row of it in a shuffle: 4 MB as broadcast, whatever the
# corpus.
BUCKETS = 1 << 20
BLOCK = 1 << 12
# Exclusive-or of a class number gives another order of classes.
ORDERS = (0, 0x5555555555555555)
# Bits of the maps of shared shingles (8 MB) and of wanted sets (2 MB).
SHARED = 1 << 26
WANTED = 1 << 24

BITS = ["b0", "b1", "b2", "b3"]
CLASS = (
    "doc_id long, row long, n_shingles long, cls long, text_key long, prefix array<long>, b0 long, b1 long, b2 long, b3 long, "
    "parity binary"
)


def shingles(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, and where each text's begin."""
    data = LOWER[t.data]
    starts, ends, owner = t.spans(NOT_SPACE[data])
    words = span_hashes(data, starts, ends)
    n = np.bincount(owner, minlength=len(t))
    hashes, at = windows(words, owner, size)
    of = owner[at]
    for short in range(1, size):
        few, at = windows(words, owner, short)
        only = n[owner[at]] == short
        hashes = np.concatenate([hashes, mix(few[only] + np.uint64(short))])
        of = np.concatenate([of, owner[at[only]]])
    order = np.argsort(of, kind="stable")
    return hashes[order], np.searchsorted(of[order], np.arange(len(t) + 1))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def parity_bits(s: np.ndarray, size: int) -> np.ndarray:
    """How many hashes fall on each of ``size`` bits, modulo 2, as bytes."""
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8))


def parity_size(n: int) -> int:
    """Bits for a set of ``n``: the next power of two from twice as many."""
    return max(256, 1 << (2 * n - 1).bit_length())


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many places two bitmaps differ; the larger one is folded to the smaller's size."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _as_rows(total: np.ndarray) -> pa.RecordBatch:
    """Counters as rows of ``BLOCK``, those without any count left out."""
    blocks = total.reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(axis=1))
    counts = pa.array([blocks[k].tobytes() for k in at], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), counts], names=["block", "counts"])


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Occurrences of all shingles, counted in ``BUCKETS`` counters by hash; beyond four
    thousand million all are equally frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for t in texts_of(batch.column(0)):
                at, n = np.unique(shingles(t, size)[0] & np.uint64(BUCKETS - 1), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        yield _as_rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint64)
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(counts.as_buffer(), np.uint32)
        yield _as_rows(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))

    schema = "block int, counts binary"
    added = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    total = np.zeros(BUCKETS, np.uint32)
    for batch in added.toArrow().to_batches():
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts.as_buffer(), np.uint32)
    return total


def signatures(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Per row of ``docs``: class, size and prefix of its set, rarest first, and the bitmap.
    Written, so that the counters need not stay on the driver and in every task."""
    order = docs.sparkSession.sparkContext.broadcast(rarity(docs, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for t in texts_of(batch.column(3)):
                hashes, begins = shingles(t, size)
                rows = []
                for a, b in zip(begins, begins[1:]):
                    s = np.unique(hashes[a:b])
                    if not len(s):
                        rows.append((0, None, [], *[0] * 4, b""))
                        continue
                    p = prefix_length(len(s), *similarity)
                    ranked = np.lexsort((s, order.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                    cls = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                    few = parity_bits(s >> np.uint64(32), 256).view(np.int64).tolist()
                    rows.append((len(s), cls, _signed(s[ranked[:p]]), *few, parity_bits(s, parity_size(len(s))).tobytes()))
                own = batch.slice(done, len(t))
                done += len(t)
                n, cls, prefix, *bits, parity = zip(*rows)
                columns = [own.column(0), own.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), own.column(2),
                           pa.array(prefix, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in bits), pa.array(parity, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CLASS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.xxhash64("text").alias("key"), "text")
    signed = cut_lineage(rows.mapInArrow(sign, CLASS))
    order.destroy()
    return signed


def _overlap(num: int, den: int) -> Column:
    """Least shared shingles of a pair with sizes ``n`` and ``m``."""
    return F.expr(f"cast(ceil({num} * (n + m) / cast({num + den} as decimal(20, 0))) as bigint)")


def _near(left: list[Column], right: list[Column]) -> Column:
    """The suffix filter on the short bitmaps of a pair with sizes ``n`` and ``m``."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)), F.lit(0))
    return differ <= F.col("n") + F.col("m") - 2 * F.col("overlap")


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (``a``, ``b``) of classes that the length and the suffix filter leave."""
    one = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n"), F.col("parity").alias("x"), *BITS)
    two = classes.select(
        F.col("cls").alias("b"), F.col("n_shingles").alias("m"), F.col("parity").alias("y"), *(F.col(c).alias(f"o{c}") for c in BITS)
    )
    short = lambda df: df.drop("x", "y")
    left = (
        pairs.join(short(one), "a")
        .join(short(two), "b")
        .filter(F.expr(f"{den} * least(n, m) >= {num} * greatest(n, m)"))
        .withColumn("overlap", _overlap(num, den))
        .filter(_near([F.col(c) for c in BITS], [F.col(f"o{c}") for c in BITS]))
        .select("a", "b", (F.col("n") + F.col("m") - 2 * F.col("overlap")).alias("most"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                bits_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= most.as_py()
                for most, x, y in zip(batch.column(2), batch.column(3), batch.column(4))
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = left.join(one.select("a", "x"), "a").join(two.select("b", "y"), "b").select("a", "b", "most", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``cls, shingles`` of the classes in ``wanted`` (``cls``, ``text_key``), written. A fixed map
    of bits says which texts to read; a collision sends a set that no pair asks for."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(seen_bits(wanted.select(F.col("text_key").alias("key")), WANTED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(known.value, batch.column(0).to_numpy())))
            for t in texts_of(batch.column(1)):
                hashes, begins = shingles(t, size)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(begins, begins[1:])]
                cls = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    found = texts.mapInArrow(read, "cls long, shingles binary")
    sets = cut_lineage(found.groupBy("cls").agg(F.first("shingles").alias("shingles")))
    known.destroy()
    return sets


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` whose whole sets have the wanted similarity."""
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _sets(docs, classes.select("cls", "text_key").join(ends, "cls", "left_semi"), size)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return cut_lineage(both.mapInArrow(verify, "a long, b long"))


def _postings(classes: DataFrame) -> DataFrame:
    """``token, place, cls, n_shingles`` and the short bitmap, of every prefix shingle that
    another class has in its prefix too, and of some whose bit is the same as of one of those;
    they make lists of one member, from which nothing follows."""
    counts = classes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("members"))
    known = classes.sparkSession.sparkContext.broadcast(seen_bits(counts.filter("members > 1"), SHARED))
    names = ["cls", "n_shingles", *BITS]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(0)
            tokens, ends = prefix.flatten().to_numpy(), np.cumsum(prefix.value_lengths().to_numpy())
            at = np.flatnonzero(has_bit(known.value, tokens))
            owner = np.searchsorted(ends, at, side="right")
            place = at - np.concatenate([[0], ends[:-1]])[owner]
            rows = batch.select(names).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), pa.array(place), *rows.columns], names=["token", "place", *names])

    written = cut_lineage(classes.select("prefix", *names).mapInArrow(post, "token long, place long, " + ", ".join(f"{n} long" for n in names)))
    known.destroy()
    return written


def _rooted(postings: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = postings.join(apart(roots.withColumnRenamed("node", "cls")), "cls", "left")
    return rooted.withColumn("root", F.coalesce("root", "cls"))


def _across(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that meet in a posting list and pass the length and
    positional filters: members outside the list's largest component with all the others."""
    by_root = postings.groupBy("token", "root").agg(F.count("*").alias("k"))
    main = by_root.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
    open_lists = cut_lineage(postings.join(apart(main.filter("roots > 1")), "token"))
    sides = ["cls", "n_shingles", "place", "root", *BITS]
    left = open_lists.filter("root <> main").select("token", *(F.col(c).alias(f"l_{c}") for c in sides))
    right = open_lists.select("token", *(F.col(c).alias(f"r_{c}") for c in sides), "main")
    # Pairs outside the largest component meet twice in a list; one of them is enough.
    met = left.join(right, "token").filter("l_root <> r_root and (r_root = main or l_cls < r_cls)")
    met = met.withColumns({"n": F.col("l_n_shingles"), "m": F.col("r_n_shingles")}).withColumn("overlap", _overlap(num, den))
    met = met.filter(F.expr(f"{den} * least(n, m) >= {num} * greatest(n, m)"))
    met = met.filter(F.least(F.col("n") - F.col("l_place"), F.col("m") - F.col("r_place")) >= F.col("overlap"))
    met = met.filter(_near([F.col(f"l_{c}") for c in BITS], [F.col(f"r_{c}") for c in BITS]))
    return met.select(F.least("l_cls", "r_cls").alias("a"), F.greatest("l_cls", "r_cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, row, root`` per row of ``docs``; ``component_id`` is
    the least ``doc_id`` that links reach, ``row`` the hash of what the row says. ``root`` (a
    class) tells components apart that have the same least ``doc_id`` or none."""
    small_batches(docs.sparkSession)
    num, den = similarity
    signed = signatures(docs, size, similarity)
    first = [F.first(c).alias(c) for c in ("prefix", *BITS, "parity")]
    classes = cut_lineage(
        signed.filter("cls is not null")
        .groupBy("cls", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), *first)
    )
    postings = _postings(classes)
    leaders = postings.groupBy("token").agg(
        *(F.min(F.col("cls").bitwiseXOR(F.lit(o))).bitwiseXOR(F.lit(o)).alias(f"first{k}") for k, o in enumerate(ORDERS))
    )
    firsts = F.array(*(F.col(f"first{k}") for k in range(len(ORDERS))))
    met = postings.select("token", "cls").join(apart(leaders), "token")
    met = met.select("cls", F.explode(F.array_distinct(firsts)).alias("first")).filter("cls <> first")
    met = met.select(F.least("cls", "first").alias("a"), F.greatest("cls", "first").alias("b")).distinct()
    small = classes.drop("prefix")
    links = _verified(docs, _possible(met, small, num, den), small, size, num, den)
    across = _across(_rooted(postings, components(links)), num, den)
    links = links.unionAll(_verified(docs, _possible(across, small, num, den), small, size, num, den))
    roots = components(links)
    placed = small.join(apart(roots.withColumnRenamed("node", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = placed.join(apart(least), "root").select("cls", "component_id", "root")
    # Empty sets meet nothing: a key of their own keeps them out of one task.
    key = F.coalesce("cls", "row")
    rows = signed.select("doc_id", "n_shingles", "row", "cls", key.alias("key"))
    found = rows.join(apart(component.withColumnRenamed("cls", "key")), "key", "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row",
        "root",
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, of several
    such rows the one with the least hash. Documents without words all stay."""
    columns = docs.columns
    near = near_duplicates(docs, size, similarity).filter("n_shingles > 0")
    best = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    has_words = F.coalesce(F.col("text").rlike("[^ \\x09-\\x0D]"), F.lit(False))
    # Grouped and joined by the same key: the texts are shuffled once.
    rows = docs.filter(has_words).withColumn("__row", row_key()).dropDuplicates(["__row"])
    kept = rows.join(best.select(F.col("best.row").alias("__row")).distinct(), "__row", "left_semi")
    return kept.select(*columns).unionAll(docs.filter(~has_words))
