"""Near copies among vectors by spherical-cap filters (operator 13).

Filter directions are products of random codes: the vector is rotated, cut into blocks, and each
block has ``K`` random unit words; a choice of one word a block is a direction. A vector's score
for a direction is the sum of its blocks' products, so the directions whose score comes within
``GAP`` of its best one are listed by branch and bound, word by word, without looking at the
others. Vectors that list the same direction are joined, bits of 128 random planes drop what is
far apart, and what is left is verified in double precision.

No list of a direction is expanded to all pairs of vectors.

* Every member first meets the list's least member; verified links give components.
* Then components meet in the lists, one row a component: their centres are closer than the
  threshold's angle and both radii, or nothing in them is linked. What passes is compared in
  blocks, the members of the smaller component as guests of the larger.
* Lists of more than ``LIST`` components are not compared: their members go on to a code of more
  words, whose caps are smaller; at ``MOST_WORDS`` all lists are compared.

Links are then counted within components, never listed. A component of at most ``GROUP``
vectors is one matrix product. In a larger one vectors lie in shells around the centre: where
two shells' angles sum to less than the threshold's, all their members are linked and counts
suffice; shells too far apart are skipped; the others are compared in blocks. So a tight group
costs rows in proportion to its size; members at the threshold have to be measured one by one.

Equal vectors are one class with a count. The join finds a link of exactly 0.95 with a chance
above 0.999 (measured over 64 dimensions), of closer vectors with more; what it finds is exact,
and so are the counts within a component.

Defined cases: vectors that are null, empty, zero, or hold nulls, NaN or infinite numbers link
with nothing, and vectors of different sizes do not link. Repeated rows are linked with each
other. ``component_id`` is null where all of a component's ids are; a row is kept if its id is
the component's, both null included. No rows give no rows. Columns other than ``vec_id`` and
``embedding`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import small_batches
from lorekeep.llm.components import components
from lorekeep.session import apart, cut_lineage

# Fixed value of the contract.
COSINE = 0.95
SEED = 13
# Dimensions of a block, at least, and blocks, at most.
BLOCK_SIZE, BLOCKS = 16, 4
# Listed directions are within GAP / sqrt(dimensions of a block) of the best score.
GAP = 0.4
# Directions of the smallest code, of a code of one block, and words of a block at most.
DIRECTIONS, ONE_BLOCK, MOST_WORDS = 1 << 16, 1 << 12, 256
# Vectors a direction's list would hold on average before more words are taken, and components
# that a list may hold before its members go on to a larger code.
LOAD, LIST = 64, 256
# Vectors of a component counted at once, and of a block of a larger one.
GROUP, COMPARED = 512, 4096
# Shells of the threshold's angle.
SHELLS = 64
# Standard deviations of the differing bits that still count as near.
DEVIATIONS = 7.0
SLACK = 1e-9

UNITS = "cls long, size int, copies long, least long, unit array<double>"


def angle_of(cosine: float) -> float:
    return math.acos(max(-1.0, min(1.0, cosine)))


def first_words(vectors: int) -> int:
    """Words a block for so many vectors, about ``LOAD`` in a list (32 lists a vector)."""
    words = round(DIRECTIONS ** (1 / BLOCKS))
    while words < MOST_WORDS and vectors * 32 > LOAD * words**BLOCKS:
        words *= 2
    return words


@lru_cache(8)
def code(size: int, words: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rotation, words of each block, and planes for vectors of a size. ``words`` is for
    ``BLOCKS`` blocks; with fewer there are more words, for as many directions."""
    rng = np.random.default_rng([SEED, size])
    planes = rng.normal(size=(size, 128))
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    blocks = max(1, min(BLOCKS, size // BLOCK_SIZE))
    words = min(words**BLOCKS, ONE_BLOCK) if blocks == 1 else round(words ** (BLOCKS / blocks))
    book = []
    for block in np.array_split(np.arange(size), blocks):
        c = rng.normal(size=(words, len(block)))
        book.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, book, planes


def listed(units: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector and number of every direction whose score is within the gap of the best one."""
    size = units.shape[1]
    rotation, book, _ = code(size, words)
    gap = GAP / math.sqrt(size / len(book))
    turned = units @ rotation
    lost, order = [], []
    for block, c in zip(np.array_split(np.arange(size), len(book)), book):
        score = turned[:, block] @ c.T
        by = np.argsort(-score, axis=1)
        score = np.take_along_axis(score, by, 1)
        lost.append(score[:, :1] - score)
        order.append(by)
    who, loss, number = np.arange(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
    for each, by in zip(lost, order):
        # What a choice loses against the best words only grows: all else is cut off.
        n = (each[who] <= (gap - loss)[:, None]).sum(axis=1)
        at = np.repeat(np.arange(len(who)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        loss = loss[at] + each[who[at], k]
        number = number[at] * each.shape[1] + by[who[at], k]
        who = who[at]
    return who, number + (size << 40)


def plane_bits(units: np.ndarray) -> np.ndarray:
    """Sides of 128 random planes, as two numbers a vector."""
    planes = code(units.shape[1], 2)[2]
    return np.packbits(units @ planes > 0, axis=1).view(np.int64).reshape(len(units), 2)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each size."""
    lengths = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.cumsum(lengths)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield at, flat[(ends[at] - size)[:, None] + np.arange(size)]


def _vectors(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


def _sound() -> Column:
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size("e") > 0) & finite & F.exists("e", lambda v: v != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of ``vec_id, e, cls`` with number, least id and unit vector."""
    groups = rows.filter(_sound()).groupBy("cls", "e").agg(F.count("*").alias("copies"), F.min("vec_id").cast("long").alias("least"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_size(batch.column(3)):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cls, copies, least = (batch.column(k).take(pa.array(at)) for k in range(3))
                columns = [cls, pa.array(np.full(len(at), x.shape[1], np.int32)), copies, least, _vectors(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "size", "copies", "least", "unit"])

    return groups.select("cls", "copies", "least", "e").mapInArrow(units, UNITS)


def _postings(vectors: DataFrame, words: int) -> DataFrame:
    """``direction, cls`` and the sides ``s0, s1`` of each listed direction."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_size(batch.column(1)):
                who, number = listed(x, words)
                sides, cls = plane_bits(x), batch.column(0).take(pa.array(at))
                columns = [pa.array(number), cls.take(pa.array(who)), pa.array(sides[who, 0]), pa.array(sides[who, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["direction", "cls", "s0", "s1"])

    return vectors.select("cls", "unit").mapInArrow(post, "direction long, cls long, s0 long, s1 long")


def _differing(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a}0 ^ {b}0) + bit_count({a}1 ^ {b}1)")


def _allowed(angle: Column) -> Column:
    """How many of 128 sides may differ at an angle."""
    p = F.least(angle / math.pi, F.lit(0.5))
    return 128 * p + DEVIATIONS * F.sqrt(128 * p * (1 - p))


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of classes whose cosine is ``least`` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for (at, x), (_, y) in zip(_by_size(batch.column(2)), _by_size(batch.column(3))):
                keep[at] = (x * y).sum(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    unit = vectors.select("cls", "unit")
    one, two = (apart(unit.toDF(k, v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _starred(postings: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Verified links of every member of a list with its least member."""
    lead = postings.groupBy("direction").agg(F.min(F.struct("cls", "s0", "s1")).alias("lead"), F.count("*").alias("n"))
    lead = lead.filter("n > 1").select("direction", F.col("lead.cls").alias("first"), F.col("lead.s0").alias("f0"), F.col("lead.s1").alias("f1"))
    met = postings.join(apart(lead), "direction").filter(F.col("cls") != F.col("first"))
    met = met.filter(_differing("s", "f") <= _allowed(F.lit(angle_of(least))))
    met = met.select(F.least("cls", "first").alias("a"), F.greatest("cls", "first").alias("b")).distinct()
    return _verified(met, vectors, least)


def _placed(vectors: DataFrame, links: DataFrame) -> DataFrame:
    """``vectors`` in components of several: with ``root``, the component's ``centre`` and the
    ``angle`` to it."""
    members = vectors.join(components(links).withColumnRenamed("node", "cls"), "cls")
    parts = members.select("root", F.posexplode("unit").alias("at", "v")).groupBy("root", "at").agg(F.sum("v").alias("v"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "v")))
    centres = parts.groupBy("root").agg(F.transform(in_order, lambda p: p["v"]).alias("centre"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "size", "copies", "least", "unit", "root", "centre", "angle"]
        for batch in batches:
            for (at, x), (_, c) in zip(_by_size(batch.column(4)), _by_size(batch.column(6))):
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                rows = batch.take(pa.array(at)).columns[:6]
                angle = np.arccos(np.clip((x * c).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*rows, _vectors(c), pa.array(angle)], names=names)

    rows = members.join(apart(centres), "root").select("cls", "size", "copies", "least", "unit", "root", "centre")
    return cut_lineage(rows.mapInArrow(measure, UNITS + ", root long, centre array<double>, angle double"))


def _components(placed: DataFrame) -> DataFrame:
    """``root, centre, radius, members`` and the centre's sides."""
    groups = placed.groupBy("root").agg(F.first("centre").alias("centre"), F.max("angle").alias("radius"), F.count("*").alias("members"))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_size(batch.column(1)):
                bits = plane_bits(x)
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(at)).columns, pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["root", "centre", "radius", "members", "c0", "c1"]
                )

    return cut_lineage(groups.mapInArrow(sides, "root long, centre array<double>, radius double, members long, c0 long, c1 long"))


def _near_components(lists: DataFrame, vectors: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of components (a vector alone is one) that meet in a list and whose centres
    are not too far apart for a link, with both centres' vectors gone and ``alone`` where both
    are single vectors, whose link is thereby verified."""
    wide = angle_of(least)
    one = lists.select("direction", *(F.col(c).alias(f"l_{c}") for c in ("root", "radius")), F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    two = lists.select("direction", *(F.col(c).alias(f"r_{c}") for c in ("root", "radius")), F.col("c0").alias("y0"), F.col("c1").alias("y1"))
    near = (F.col("l_root") < F.col("r_root")) & (_differing("x", "y") <= _allowed(wide + F.col("l_radius") + F.col("r_radius")))
    met = one.join(two, (one["direction"] == two["direction"]) & near).select(F.col("l_root").alias("a"), F.col("r_root").alias("b")).distinct()
    single = vectors.join(groups.select(F.col("root").alias("cls")), "cls", "left_anti")
    nodes = single.select(F.col("cls").alias("root"), F.col("unit").alias("centre"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("members"))
    nodes = cut_lineage(nodes.unionByName(groups.select("root", "centre", "radius", "members")))
    found = "a long, b long, a_members long, b_members long"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            radii = batch.column(6).to_numpy() + batch.column(7).to_numpy()
            for (at, x), (_, y) in zip(_by_size(batch.column(4)), _by_size(batch.column(5))):
                limit = np.where(radii[at] > 0, np.cos(np.minimum(wide + radii[at] + SLACK, math.pi)), least)
                keep[at] = (x * y).sum(axis=1) >= limit
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    sides = [apart(nodes.select(F.col("root").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("centre", "radius", "members")))) for k in "ab"]
    both = met.join(sides[0], "a").join(sides[1], "b")
    both = both.select("a", "b", "a_members", "b_members", "a_centre", "b_centre", "a_radius", "b_radius")
    return cut_lineage(both.mapInArrow(reach, found))


def _block_links(guests: DataFrame, hosts: DataFrame, least: float) -> DataFrame:
    """The nearest linked host of each guest, block by block. Both: ``key, cls, unit``."""
    count = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / COMPARED).cast("int").alias(name))
    blocks = cut_lineage(count(guests, "g").join(count(hosts, "h"), "key"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int").alias(f"{own}_block")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_block")
        return df.join(apart(blocks), "key").select("key", mine, each, "cls", "unit")

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            x, y = (np.concatenate([m for _, m in _by_size(t["unit"].combine_chunks())]) for t in (left, right))
            names, others = left["cls"].to_numpy(), right["cls"].to_numpy()
            best, at = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
            for k in range(0, len(x), 256):
                cosines = x[k : k + 256] @ y.T
                at[k : k + 256] = cosines.argmax(axis=1)
                best[k : k + 256] = cosines.max(axis=1)
            a, b = names[best >= least], others[at[best >= least]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    keys = ["key", "g_block", "h_block"]
    left, right = dealt(guests, "g", "h"), dealt(hosts, "h", "g")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "a long, b long")


def _crossing(close: DataFrame, vectors: DataFrame, placed: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links between components that are close, the smaller one's members as guests."""
    pairs = close.filter("a_members > 1 or b_members > 1")
    larger = F.struct("b_members", "b") > F.struct("a_members", "a")
    pairs = pairs.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("guest"))
    single = vectors.join(placed.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("root"), "unit")
    every = placed.select("cls", "root", "unit").unionByName(single)
    around = groups.select(F.col("root").alias("key"), "centre", "radius")
    asked = pairs.join(every.withColumnRenamed("root", "guest"), "guest").join(apart(around), "key")
    wide = angle_of(least)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            radii = batch.column(4).to_numpy()
            for (at, x), (_, y) in zip(_by_size(batch.column(2)), _by_size(batch.column(3))):
                keep[at] = (x * y).sum(axis=1) >= np.cos(np.minimum(wide + radii[at] + SLACK, math.pi))
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    guests = asked.select("key", "cls", "unit", "centre", "radius").mapInArrow(reach, "key long, cls long, unit array<double>")
    guests = cut_lineage(guests)
    hosts = placed.select(F.col("root").alias("key"), "cls", "unit").join(apart(guests.select("key").distinct()), "key", "left_semi")
    return _block_links(guests, hosts, least)


def _links(vectors: DataFrame, least: float) -> DataFrame:
    """Verified links that hold every component together."""
    words = first_words(vectors.count())
    todo, links = vectors, vectors.sparkSession.createDataFrame([], "a long, b long")
    while True:
        postings = cut_lineage(_postings(todo, words))
        links = cut_lineage(links.unionAll(_starred(postings, vectors, least)))
        placed = _placed(vectors, links)
        groups = _components(placed)
        member = placed.select("cls", "root").join(groups.select("root", "radius", "c0", "c1"), "root")
        named = postings.join(apart(member), "cls", "left")
        lists = named.select(
            "direction",
            F.coalesce("root", "cls").alias("root"),
            F.coalesce("radius", F.lit(0.0)).alias("radius"),
            *(F.coalesce(f"c{k}", f"s{k}").alias(f"c{k}") for k in (0, 1)),
        ).distinct()
        lists = cut_lineage(lists)
        full = None
        if words < MOST_WORDS:
            full = cut_lineage(lists.groupBy("direction").count().filter(F.col("count") > LIST).select("direction"))
            if full.isEmpty():
                full = None
            else:
                lists = lists.join(apart(full), "direction", "left_anti")
        close = _near_components(lists, vectors, groups, least)
        alone = close.filter("a_members = 1 and b_members = 1").select("a", "b")
        links = cut_lineage(links.unionAll(alone).unionAll(_crossing(close, vectors, placed, groups, least)))
        if full is None:
            return links
        dense = postings.join(apart(full), "direction", "left_semi").select("cls").distinct()
        todo, words = cut_lineage(vectors.join(dense, "cls", "left_semi")), words * 2


def _counted_small(members: DataFrame, least: float) -> DataFrame:
    """``cls, linked``: rows linked with a class, itself included, in components of at most
    ``GROUP`` vectors, a list a component."""
    lists = members.groupBy("root").agg(F.collect_list(F.struct("cls", "copies", "unit")).alias("rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            rows, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy())
            cls, copies, units = (rows.field(k) for k in ("cls", "copies", "unit"))
            flat, sizes, copies = units.flatten().to_numpy(), units.value_lengths().to_numpy(), copies.to_numpy()
            begins, linked, low = np.cumsum(sizes) - sizes, np.zeros(len(cls), np.int64), 0
            for high in ends:
                x = flat[begins[low] : begins[low] + sizes[low] * (high - low)].reshape(high - low, -1)
                near = x @ x.T >= least
                np.fill_diagonal(near, True)
                linked[low:high] = near @ copies[low:high]
                low = high
            yield pa.RecordBatch.from_arrays([cls, pa.array(linked)], names=["cls", "linked"])

    return lists.select("rows").mapInArrow(count, "cls long, linked long")


def _counted_large(members: DataFrame, least: float) -> DataFrame:
    """The same in larger components, as sums to be added up: shells that are linked for certain
    by their counts, the doubtful ones block by block."""
    wide = angle_of(least)
    shelled = cut_lineage(members.select("root", "cls", "copies", "unit", F.floor(F.col("angle") * (SHELLS / wide)).cast("int").alias("shell")))
    shells = cut_lineage(
        shelled.groupBy("root", "shell").agg(F.sum("copies").alias("held"), F.ceil(F.count("*") / COMPARED).cast("int").alias("blocks"))
    )
    mine, other = shells.toDF("root", "shell", "held", "blocks"), shells.toDF("root", "o_shell", "o_held", "o_blocks")
    # A shell's members are up to one shell further out than its number; a hair against rounding.
    pairs = mine.join(other, "root")
    sure = pairs.filter(F.col("shell") + F.col("o_shell") + 2 <= SHELLS - 1).groupBy("root", "shell").agg(F.sum("o_held").alias("linked"))
    by_count = shelled.join(apart(sure), ["root", "shell"]).select("cls", "linked")
    doubtful = (F.col("shell") + F.col("o_shell") + 2 > SHELLS - 1) & (F.abs(F.col("shell") - F.col("o_shell")) <= SHELLS + 1)
    pairs = cut_lineage(pairs.filter(doubtful).select("root", "shell", "blocks", "o_shell", "o_blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")
    each = F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)).alias("o_block")
    keys = ["root", "shell", "block", "o_shell", "o_block"]
    left = shelled.join(apart(pairs), ["root", "shell"]).select("root", "shell", own, "o_shell", each, "cls", "copies", "unit")
    swapped = shelled.select("root", F.col("shell").alias("o_shell"), "cls", "copies", "unit").join(apart(pairs), ["root", "o_shell"])
    right = swapped.select(
        "root", "shell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "o_shell",
        F.pmod(F.xxhash64("cls"), F.col("o_blocks")).cast("int").alias("o_block"), "cls", "copies", "unit",
    )

    def count(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"cls": pa.array([], pa.int64()), "linked": pa.array([], pa.int64())})
        x, y = (np.concatenate([m for _, m in _by_size(t["unit"].combine_chunks())]) for t in (left, right))
        names, others, copies = left["cls"].to_numpy(), right["cls"].to_numpy(), right["copies"].to_numpy()
        linked = np.zeros(len(x), np.int64)
        for k in range(0, len(x), 256):
            near = (x[k : k + 256] @ y.T >= least) | (names[k : k + 256, None] == others)
            linked[k : k + 256] = near @ copies
        return pa.table({"cls": left["cls"], "linked": pa.array(linked)})

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, "cls long, linked long")
    return by_count.unionAll(compared)


def near_vectors(rows: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row: how many other rows have a cosine of
    ``least`` or more, the least id that links reach, and whether it is the row's own."""
    small_batches(rows.sparkSession)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("cls", F.xxhash64("e"))
    vectors = cut_lineage(classes(rows))
    placed = _placed(vectors, _links(vectors, least))
    sizes = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    members = placed.join(apart(sizes), "root")
    counted = _counted_small(members.filter(F.col("members") <= GROUP), least)
    counted = counted.unionAll(_counted_large(members.filter(F.col("members") > GROUP), least))
    total = counted.groupBy("cls").agg(F.sum("linked").alias("linked"))
    found = members.select("cls", "component_id").join(total, "cls")
    facts = vectors.select("cls", "copies", "least").join(found, "cls", "left")
    # A vector alone is linked with its copies only.
    facts = facts.select(
        "cls",
        (F.coalesce("linked", "copies") - 1).alias("n_links"),
        F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )
    # Broken vectors meet nothing: a key of their own keeps them out of one task.
    keyed = rows.select("vec_id", F.when(_sound(), F.col("cls")).alias("cls"))
    keyed = keyed.withColumn("key", F.coalesce("cls", F.xxhash64("vec_id")))
    joined = keyed.join(apart(facts.withColumnRenamed("cls", "key")), "key", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("cls").isNull(), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
