"""Approximate nearest vectors over a stored index of cells and product codes.

Cells are k-means centres trained on a bounded sample; every vector of the corpus is assigned to
its nearest one. What a vector differs from its centre by is cut into sub-vectors, and each
becomes one byte, the nearest of up to 256 trained words. The index is two tables: ``lists``
(cell, id, code), ordered by cell, and ``model``, the centres, words and number of probes.

A question goes to its ``probes`` nearest cells. Only the codes of those are read and shuffled,
a small part of the vectors' size, and measured as the vectors that they stand for. Cells lie
together in parts of about ``CODE_BLOCK`` codes; a question travels once to a part, with the cells
it looks into, and each block of a part passes on its best ``shortlist``, so what is shuffled
follows the number of parts and not of cells. The best ``shortlist`` of all are measured again on
the vectors themselves, so distances and order among what was found are exact. A shortlist that
has room for all codes would cut nothing; then the vectors of the cells are measured at once.
Questions that find fewer than k go on with twice the probes, and in the end to all cells, so k
are found wherever the corpus has them.

How many probes are needed depends on the data, so it is measured when the index is built: for a
sample of vectors the exact search says in which cells their nearest neighbours lie. Where
nothing is clustered that is nearly all of them, as no index can help there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.operators.knn import FEW_ROWS, _blocks, _first_copies, _matrix, _rank, _sound_sides, knn
from lorekeep.session import apart, cut_lineage

# Vectors that the cells and words are trained on, at most, and rounds of k-means.
TRAINED_ON = 32768
ROUNDS = 12
# Cells are twice the square root of the vectors, this many at most: 16 MB of 256 dimensions.
MAX_CELLS = 8192
# Dimensions of a sub-vector, and words for each.
SUB, WORDS = 4, 256
# Vectors on which probes are measured, neighbours of each, and the share that probes must reach.
MEASURED, NEIGHBOURS, REACHED = 256, 10, 0.97
# Codes measured again per answer wanted, and at least.
AGAIN, LEAST_AGAIN = 16, 64
# Rows of a block of questions and of codes, and distances that a task holds at once.
QUESTION_BLOCK, CODE_BLOCK = 4096, 131072
SCORED = 1 << 21


@dataclass
class Cells:
    """What every task needs to know of an index; its size is bounded by the constants above."""

    centres: np.ndarray
    words: np.ndarray
    probes: int

    @property
    def subs(self) -> int:
        return len(self.words)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``x``; one that loses all its vectors moves to one that lies far off."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, gap = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance."""
    near, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    norms = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        d = norms - 2.0 * (part @ centres.T) + (part * part).sum(axis=1)[:, None]
        near[at : at + 1024] = d.argmin(axis=1)
        gap[at : at + 1024] = d.min(axis=1)
    return near, gap


def _subs(x: np.ndarray) -> list[np.ndarray]:
    return np.array_split(x, max(1, x.shape[1] // SUB), axis=1)


def _padded(words: list[np.ndarray], width: int) -> np.ndarray:
    """Words of all sub-vectors as one array; places without a word are infinitely far."""
    out = np.full((len(words), WORDS, width), np.inf)
    for k, w in enumerate(words):
        out[k, : len(w), : w.shape[1]] = w
        out[k, : len(w), w.shape[1] :] = 0.0
    return out


def train(vectors: DataFrame, n: int, seed: int = 7) -> Cells:
    """Cells and words from at most ``TRAINED_ON`` vectors, taken by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(TRAINED_ON).select("embedding").toArrow()
    x, rng = _matrix(rows["embedding"]), np.random.default_rng(seed)
    cells = max(1, min(MAX_CELLS, round(2 * n**0.5), len(x) // 8))
    centres = kmeans(x, cells, rng)
    rest = x - centres[nearest(x, centres)[0]]
    words = [kmeans(part, WORDS, rng) for part in _subs(rest)]
    return Cells(centres, _padded(words, max(w.shape[1] for w in words)), len(centres))


def codes(x: np.ndarray, model: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Cell and code of each row."""
    cell, _ = nearest(x, model.centres)
    parts = _subs(x - model.centres[cell])
    found = [nearest(p, w[np.isfinite(w[:, 0])][:, : p.shape[1]])[0].astype(np.uint8) for p, w in zip(parts, model.words)]
    return cell, np.column_stack(found)


def tables(rest: np.ndarray, model: Cells) -> np.ndarray:
    """Squared distances of each row's sub-vectors to all words: row, sub-vector, word."""
    out = np.empty((len(rest), model.subs, WORDS))
    for k, (part, words) in enumerate(zip(_subs(rest), model.words)):
        there = np.isfinite(words[:, 0])
        w = words[there][:, : part.shape[1]]
        out[:, k, : len(w)] = (part * part).sum(axis=1)[:, None] - 2.0 * (part @ w.T) + (w * w).sum(axis=1)
    return out


def _listed(vectors: DataFrame, model) -> DataFrame:
    """``cell, id, code`` of every vector; a narrow map."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), vectors.schema["id"], T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = codes(_matrix(pa.chunked_array([batch.column(1)])), model.value)
                rows = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), rows], names=["cell", "id", "code"])

    return vectors.select("id", "embedding").mapInArrow(run, schema)


def _measured_probes(vectors: DataFrame, lists: DataFrame, model: Cells) -> int:
    """The least number of cells in which a sample of vectors finds ``REACHED`` of its nearest
    neighbours; the exact search of so few questions is one pass over the corpus."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MEASURED)
    asked = cut_lineage(sample.select(F.col("id").alias("query_id"), "embedding").dropDuplicates(["query_id"]))
    true = knn(asked, vectors, NEIGHBOURS + 1).filter(F.col("query_id") != F.col("id"))
    where = true.select("query_id", "id").join(lists.select("id", "cell").distinct(), "id")
    found = where.join(asked, "query_id").select("cell", "embedding").toArrow()  # MEASURED * NEIGHBOURS rows
    if not found.num_rows:
        return len(model.centres)
    x, cell = _matrix(found["embedding"]), found["cell"].to_numpy()
    d = (model.centres * model.centres).sum(axis=1) - 2.0 * (x @ model.centres.T)
    place = (d < d[np.arange(len(x)), cell][:, None]).sum(axis=1)
    return int(np.quantile(place, REACHED, method="higher")) + 1


def build_cells(vectors: DataFrame, seed: int = 7) -> tuple[DataFrame, Cells]:
    """The index of ``id, embedding``: lists ordered by cell, written, and the model. Broken
    vectors are left out, as in the exact search."""
    _, vectors = _sound_sides(vectors.withColumnRenamed("id", "query_id"), vectors)
    n = vectors.count()
    if not n:
        empty = T.StructType([T.StructField("cell", T.IntegerType()), vectors.schema["id"], T.StructField("code", T.BinaryType())])
        return vectors.sparkSession.createDataFrame([], empty), Cells(np.zeros((0, 1)), np.zeros((0, WORDS, 1)), 0)
    model = train(vectors, n, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    # A hot cell is cut by id; rows of a cell lie together, so that a filter on cells reads few.
    lists = _listed(vectors, shared).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    lists = cut_lineage(lists)
    shared.destroy()
    model.probes = _measured_probes(vectors, lists, model)
    return lists, model


def model_rows(spark: SparkSession, model: Cells) -> DataFrame:
    """The model as a table of one row an array."""
    rows = [(name, list(a.shape), a.astype("<f8").tobytes()) for name, a in (("centres", model.centres), ("words", model.words))]
    rows.append(("probes", [1], np.array([model.probes], "<f8").tobytes()))
    return spark.createDataFrame(rows, "name string, shape array<int>, numbers binary")


def read_model(rows: DataFrame) -> Cells:
    found = {r.name: np.frombuffer(r.numbers, "<f8").reshape(r.shape) for r in rows.collect()}
    return Cells(found["centres"], found["words"], int(found["probes"][0]))


@dataclass
class Parts:
    """Cells put together so that a part's codes fill a task; a larger cell is a part by itself."""

    members: list[np.ndarray]
    rows: list[int]


def _parts(lists: DataFrame, cells: int) -> Parts:
    """From the sizes of the cells, at most ``MAX_CELLS`` numbers. There are as many parts as
    cores where the codes would not give each core a full one."""
    sizes = np.zeros(cells, np.int64)
    for row in lists.groupBy("cell").count().collect():
        sizes[row.cell] = row["count"]
    cores = lists.sparkSession.sparkContext.defaultParallelism
    most = min(CODE_BLOCK, max(FEW_ROWS, -(-int(sizes.sum()) // cores)))
    members, rows = [], []
    for cell in np.flatnonzero(sizes):
        if members and rows[-1] + sizes[cell] <= most:
            members[-1].append(cell)
            rows[-1] += int(sizes[cell])
        else:
            members.append([cell])
            rows.append(int(sizes[cell]))
    return Parts([np.array(m) for m in members], rows)


def _probed(questions: DataFrame, shared, probes: int) -> DataFrame:
    """``part, query_id, embedding, probed``: each question once for each part that has cells
    which it looks into, with these as bits."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), questions.schema["query_id"], questions.schema["embedding"], T.StructField("probed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, parts = shared.value
        centres = model.centres
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                x = _matrix(pa.chunked_array([batch.column(1)]))
                chosen = np.ones((len(x), len(centres)), bool)
                if probes < len(centres):
                    d = (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)
                    chosen[:] = False
                    np.put_along_axis(chosen, np.argpartition(d, probes - 1, axis=1)[:, :probes], True, axis=1)
                for part, members in enumerate(parts.members):
                    asks = np.flatnonzero(chosen[:, members].any(axis=1))
                    if len(asks):
                        bits = [row.tobytes() for row in np.packbits(chosen[np.ix_(asks, members)], axis=1)]
                        columns = [pa.array(np.full(len(asks), part, np.int32)), *batch.take(pa.array(asks)).columns, pa.array(bits, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return questions.select("query_id", "embedding").mapInArrow(run, schema)


def _decoded(cell: np.ndarray, code: np.ndarray, model: Cells) -> np.ndarray:
    """The vectors that codes stand for: the centre of the cell and the words."""
    widths = [part.shape[1] for part in _subs(model.centres[:1])]
    return model.centres[cell] + np.concatenate([words[c, :w] for words, c, w in zip(model.words, code.T, widths)], axis=1)


def _roughly(q: np.ndarray, probed: np.ndarray, place: np.ndarray, codes: np.ndarray, model: Cells, members: np.ndarray, top: int):
    """The ``top`` codes next to each question in the cells it looks into, and their squared
    distances; a place without a code is infinitely far."""
    best, rough = np.zeros((len(q), top), np.int64), np.full((len(q), top), np.inf)
    q_norm = (q * q).sum(axis=1)[:, None]
    for c in np.unique(place):
        at, who = np.flatnonzero(place == c), np.flatnonzero(probed[:, c])
        x = _decoded(np.full(len(at), members[c]), codes[at], model)
        norms, step = (x * x).sum(axis=1), max(1, SCORED // (len(at) + top))
        for w in (who[k : k + step] for k in range(0, len(who), step)):
            d = np.concatenate([rough[w], norms - 2.0 * (q[w] @ x.T) + q_norm[w]], axis=1)
            ids = np.concatenate([best[w], np.broadcast_to(at, (len(w), len(at)))], axis=1)
            least = np.argpartition(d, top - 1, axis=1)[:, :top]
            best[w], rough[w] = np.take_along_axis(ids, least, 1), np.take_along_axis(d, least, 1)
    return best, rough


def _exactly(q: np.ndarray, probed: np.ndarray, place: np.ndarray, x: np.ndarray, top: int):
    """The same for vectors themselves, in order of their ids, which come first at a tie."""
    best, gap = np.zeros((len(q), top), np.int64), np.full((len(q), top), np.inf)
    norms, step = (x * x).sum(axis=1), max(1, SCORED // len(x))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d = norms - 2.0 * (part @ x.T)
        d[~probed[at : at + step][:, place]] = np.inf
        # Whatever is within the rounding error of the last one is measured again.
        slack = 1e-9 * (1.0 + norms.max() + (part * part).sum(axis=1))
        limit = np.partition(d, top - 1, axis=1)[:, top - 1] + slack
        for k, row in enumerate(part):
            near = np.flatnonzero((d[k] <= limit[k]) & (d[k] < np.inf))
            true = ((x[near] - row) ** 2).sum(axis=1)
            least = np.argsort(true, kind="stable")[:top]
            best[at + k, : len(least)], gap[at + k, : len(least)] = near[least], true[least]
    return best, gap


def _shortlisted(probed: DataFrame, listed: DataFrame, shared, parts: Parts, top: int) -> DataFrame:
    """``query_id, id, rough``: the best ``top`` rows of each question and block of a part.
    ``listed`` is (cell, id, code), or (cell, id, embedding) to measure the vectors themselves."""
    spark, kind = probed.sparkSession, listed.columns[-1]
    cells = [(int(cell), n, -(-parts.rows[n] // CODE_BLOCK)) for n, members in enumerate(parts.members) for cell in members]
    of_cell = F.broadcast(spark.createDataFrame(cells, "cell int, part int, v_blocks int"))
    of_part = spark.createDataFrame(sorted({c[1:] for c in cells}), "part int, v_blocks int")
    most = max(1, min(QUESTION_BLOCK, SCORED // top))
    asked = probed.groupBy("part").agg(_blocks(F.count("*"), most).alias("q_blocks"))
    # A row a part: as many as cores, or one for CODE_BLOCK codes.
    blocks = F.broadcast(cut_lineage(of_part.join(asked, "part")))
    query, key = probed.schema["query_id"], listed.schema["id"]
    schema = T.StructType([query, key, T.StructField("rough", T.DoubleType())])
    form = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def search(group, asked: pa.Table, listed: pa.Table) -> pa.Table:
        if not (asked.num_rows and listed.num_rows):
            return form.empty_table()
        (known, parts), q = shared.value, _matrix(asked["embedding"])
        members, listed = parts.members[group[0].as_py()], listed.sort_by("id")
        bits = np.frombuffer(b"".join(asked["probed"].to_pylist()), np.uint8).reshape(len(q), -1)
        looks = np.unpackbits(bits, axis=1, count=len(members)).astype(bool)
        place = np.searchsorted(members, listed["cell"].to_numpy())
        if kind == "code":
            code = np.frombuffer(b"".join(listed["code"].to_pylist()), np.uint8).reshape(listed.num_rows, -1)
            best, rough = _roughly(q, looks, place, code, known, members, min(top, listed.num_rows))
        else:
            x = _matrix(listed["v_embedding"])
            kept = _first_copies(np.column_stack([x, place]), listed["id"], top)
            listed = listed.take(pa.array(kept))
            best, rough = _exactly(q, looks, place[kept], x[kept], min(top, len(kept)))
        row, column = np.nonzero(np.isfinite(rough))
        columns = [asked["query_id"].take(pa.array(row)), listed["id"].take(pa.array(best[row, column])), pa.array(rough[row, column])]
        return pa.table(columns, schema=form)

    own = lambda name, side: F.pmod(F.xxhash64(name), F.col(f"{side}_blocks")).cast("int").alias(f"{side}_block")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_blocks") - 1)).alias(f"{side}_block")
    left = probed.join(blocks, "part").select(F.col("part").alias("part"), own("query_id", "q"), each("v"), "query_id", "embedding", "probed")
    rows = listed.join(of_cell.drop("v_blocks"), "cell").join(blocks, "part")
    right = rows.select(F.col("part").alias("part"), each("q"), own("id", "v"), "cell", "id", F.col(kind).alias("code" if kind == "code" else "v_embedding"))
    keys = ["part", "q_block", "v_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def search_cells(
    questions: DataFrame, vectors: DataFrame, lists: DataFrame, model: Cells, k: int, *, probes: int | None = None, shortlist: int | None = None
) -> DataFrame:
    """``query_id, rank, id, distance`` of the k nearest vectors that the probed cells hold, ties
    by id. ``vectors`` are measured for the shortlisted ids only."""
    spark = vectors.sparkSession
    if not len(model.centres):
        return knn(questions, vectors, k)
    questions, sound = _sound_sides(questions, vectors)
    shortlist = shortlist or max(LEAST_AGAIN, AGAIN * k)
    probes = min(probes or model.probes, len(model.centres))
    parts = _parts(lists, len(model.centres))
    # A shortlist that holds all codes cuts nothing: the vectors of the cells are measured at
    # once, and k of a block go on.
    whole = shortlist >= sum(parts.rows)
    top = max(1, k if whole else shortlist)
    listed = lists.select("cell", "id").join(sound.select("id", "embedding"), "id").select("cell", "id", "embedding") if whole else lists.select("cell", "id", "code")
    shared, todo, found = spark.sparkContext.broadcast((model, parts)), questions, None
    while True:
        probed, read = cut_lineage(_probed(todo, shared, probes)), listed
        if 2 * probes < len(model.centres):
            # Parts that nobody asks for are not read.
            asked = [r.part for r in probed.select("part").distinct().collect()]
            read = listed.filter(F.col("cell").isin([int(c) for p in asked for c in parts.members[p]]))
        rough = _shortlisted(probed, read, shared, parts, top)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "id"))
        few = rough.withColumn("place", order).filter(F.col("place") <= shortlist).select("query_id", "id")
        measured = few.join(todo.withColumnRenamed("embedding", "q"), "query_id").join(vectors.withColumnRenamed("embedding", "v"), "id")
        # As in the exact search: the root of a sum of squares, in double.
        gaps = F.zip_with("q", "v", lambda a, b: a.cast("double") - b.cast("double"))
        distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))
        ranked = cut_lineage(_rank(measured.select("query_id", "id", distance.alias("distance")), k))
        if probes >= len(model.centres):
            shared.destroy()
            return ranked if found is None else found.unionByName(ranked)
        full = ranked.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
        done = ranked.join(apart(full), "query_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        todo = cut_lineage(todo.join(apart(full), "query_id", "left_anti"))
        if todo.isEmpty():
            shared.destroy()
            return found
        probes = min(2 * probes, len(model.centres))

