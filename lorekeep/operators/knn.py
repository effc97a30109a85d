"""Nearest vectors for a whole table of questions, by L2 distance.

Exact search divides the corpus into cells around pivots. A question searches its own
cell first, which bounds the distance of its k-th neighbour, and then only those cells
that the triangle inequality does not rule out. Approximate search hashes both sides
and looks into the buckets of the question only.

Either way the work is a join on a cell key. A cell, however many rows it holds, is cut
into blocks of questions and blocks of vectors, and one task scores one pair of blocks
with a matrix product and passes on k rows per question. Neither a hot cell nor a large
question table meets in one task, and pairs of rows are never materialised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.session import apart, cut_lineage

# Rows per block on either side, at most. A vector travels once for each block of
# questions and a question once for each block of vectors, so blocks are as large as a
# task can hold: 65,536 vectors of 256 dimensions take 64 MB. Where there is little to
# search, blocks of FEW_ROWS spread it over the cores.
QUESTION_BLOCK = 32768
VECTOR_BLOCK = 65536
FEW_ROWS = 2048
# Products of questions and vectors that a task holds at once, for so many questions, and
# vectors of a group, for which their least product stands; a power of two.
ROUGH = 1 << 19
STEP = 256
GROUP = 16
# Rows that a task repeats once a hash table and sends on together.
SENT_ROWS = 1024
# Exact search starts to divide the corpus beyond this many vectors per cell. The
# pivots, the only thing sent to every task, are bounded by MAX_CELLS.
CELL_ROWS = 65536
MAX_CELLS = 1024


def vector_size(rows: DataFrame) -> int | None:
    """How many numbers most of the vectors have; None where there are none."""
    sizes = rows.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else None


def _is_sound(size: int) -> Column:
    # Null where a number is missing, true where one is NaN.
    broken = F.array_contains("embedding", float("nan"))
    return F.coalesce((F.size("embedding") == size) & ~broken, F.lit(False))


def rejected(rows: DataFrame) -> DataFrame:
    """The rows that no search can use: vectors that are null, empty, of another size than
    most, or with numbers that are null or NaN."""
    return rows.filter(~_is_sound(vector_size(rows) or 0))


def _sound_sides(questions: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without their rejected rows; sides of different sizes are an error."""
    asked, size = vector_size(questions), vector_size(vectors)
    if asked and size and asked != size:
        raise ValueError(f"questions have {asked} dimensions, vectors {size}")
    keep = _is_sound(size or asked or 0)
    return questions.filter(keep), vectors.filter(keep)


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """A row a vector, in numbers as they came; not copied where they lie together."""
    chunks = [c.flatten() for c in column.chunks]
    flat = chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], pa.float64())
    values = flat.to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _values(column).astype(np.float64)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row first stands, and for every row the number of its kind."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, kind = np.unique(whole, return_index=True, return_inverse=True)
    return first, kind.ravel()


def _first_copies(x: np.ndarray, ids: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    """Rows without those that cannot be among anyone's k nearest: of equal vectors the
    k smallest ids come first at every distance."""
    if not len(x):
        return np.empty(0, dtype=int)
    _, kind = _groups(x)
    by_id = pc.sort_indices(ids).to_numpy()
    order = by_id[np.argsort(kind[by_id], kind="stable")]
    sizes = np.bincount(kind)
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[place < k])


def _measured(row: np.ndarray, near: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors at ``near``, places in order, are nearest, and their distances."""
    step = max(top, ROUGH // len(row))
    best, gap = np.empty(0, dtype=int), np.empty(0)
    for at in range(0, len(near), step):
        part = near[at : at + step]
        distance = np.sqrt(((v[part].astype(np.float64) - row) ** 2).sum(axis=1))
        best, gap = np.concatenate([best, part]), np.concatenate([gap, distance])
        least = np.argsort(gap, kind="stable")[:top]
        best, gap = best[least], gap[least]
    return best, gap


def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the places of its k nearest rows of ``v``, ties by place, and their
    distances.

    ‖v‖² − 2·q·v orders like the distance but for rounding. It is taken in single precision, and
    only the least of a group of vectors is kept: the k-th of these bounds the k-th neighbour.
    Groups within the rounding error of that bound are measured again exactly.
    """
    n, size = v.shape
    top = min(k, n)
    best = np.empty((len(q), top), dtype=int)
    gap = np.empty(best.shape)
    group = 1 << max(1, min(GROUP, n // (4 * top))).bit_length() - 1
    padded = -(-n // group) * group
    with np.errstate(over="ignore", invalid="ignore"):
        # Distances stay when both sides are moved; around the middle of the vectors, rounding
        # is least.
        middle = v.mean(axis=0, dtype=np.float64)
        moved, norm = np.zeros((padded, size), dtype=np.float32), np.full(padded, np.inf, dtype=np.float32)
        longest, step = 0.0, max(1, ROUGH // size)
        for at in range(0, n, step):
            part = v[at : at + step] - middle
            square = (part * part).sum(axis=1)
            moved[at : at + len(part)], norm[at : at + len(part)] = part, square
            longest = np.maximum(longest, square.max())
        # Vectors at a time, and for each group its first one and how far apart they are.
        width = max(1, ROUGH // STEP // group) * group
        chunks = [(at, min(at + width, padded)) for at in range(0, padded, width)]
        first = np.concatenate([np.arange(at, at + (to - at) // group) for at, to in chunks])
        apart_by = np.concatenate([np.full((to - at) // group, (to - at) // group) for at, to in chunks])
        for at in range(0, len(q), STEP):
            asked = q[at : at + STEP].astype(np.float64)
            part = asked - middle
            reach = (part * part).sum(axis=1) + longest
            part = (-2.0 * part).astype(np.float32)
            least = np.empty((len(part), len(first)), dtype=np.float32)
            done = 0
            for start, end in chunks:
                rough = part @ moved[start:end].T
                rough += norm[start:end]
                groups = (end - start) // group
                while (half := rough.shape[1] // 2) >= groups:
                    rough = np.minimum(rough[:, :half], rough[:, half:])
                least[:, done : done + groups] = rough
                done += groups
            # Twice what a product may be off by, and what is too small for single precision.
            slack = 4.0 * (size + 8) * 2.0**-24 * reach + (size + 8) * 1e-37
            limit = np.partition(least, top - 1, axis=1)[:, top - 1] + slack
            # Beyond single precision everything is measured.
            limit[~(reach < 1e36)] = np.inf
            row, held = np.nonzero(~(least > limit[:, None]))
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            for i, values in enumerate(asked):
                of = held[ends[i] : ends[i + 1]]
                near = (first[of][:, None] + apart_by[of][:, None] * np.arange(group)).ravel()
                near = np.sort(near[near < n])
                best[at + i], gap[at + i] = _measured(values, near, v, top)
    return best, gap


def _block_search(k: int, id_type: pa.DataType, query_type: pa.DataType):
    """k nearest vectors of one block for each question of another."""

    def search(_key, questions: pa.Table, vectors: pa.Table) -> pa.Table:
        if questions.num_rows and vectors.num_rows:
            x, ids = _values(vectors["v_block_embedding"]), vectors["id"]
            kept = _first_copies(x, ids, k)
            kept = kept[pc.sort_indices(ids.take(pa.array(kept))).to_numpy()]
            ids = ids.take(pa.array(kept))
            q = _values(questions["q_block_embedding"])
            # Equal questions have equal answers.
            asked, kind = _groups(q)
            best, gap = _nearest(q[asked], x[kept], k)
            return pa.table(
                {
                    "query_id": questions["query_id"].take(pa.array(np.repeat(np.arange(len(kind)), best.shape[1]))),
                    "id": ids.take(pa.array(best[kind].ravel())),
                    "distance": pa.array(gap[kind].ravel()),
                }
            )
        return pa.table(
            {
                "query_id": pa.array([], query_type),
                "id": pa.array([], id_type),
                "distance": pa.array([], pa.float64()),
            }
        )

    return search


def _blocks(n: Column, most: int, cores: int = 1) -> Column:
    """How many blocks ``n`` rows make: as few as fit, or one per core of FEW_ROWS."""
    return F.greatest(F.ceil(n / most), F.least(F.ceil(n / FEW_ROWS), F.lit(cores)), F.lit(1)).cast("int")


def _search_blocks(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance``: at least the k nearest within the question's cell.

    Both sides have ``cell`` and ``embedding``, a key, and ``q_blocks`` and ``v_blocks``,
    the numbers of blocks their cell is cut into. A row belongs to one block of its own
    side, by a hash of its key, and meets every block of the other.
    """

    def spread(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return rows.select(
            F.col("cell").alias("cell"),
            F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
            key,
            F.col("embedding").alias(f"{own}_block_embedding"),
        )

    query_type, id_type = questions.schema["query_id"].dataType, vectors.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    key = ["cell", "q_block", "v_block"]
    left, right = spread(questions, "query_id", "q", "v"), spread(vectors, "id", "v", "q")
    search = _block_search(k, to_arrow_type(id_type), to_arrow_type(query_type))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def _search_cells(questions: DataFrame, vectors: DataFrame, k: int, *, cells: int | None = None) -> DataFrame:
    """The same for (cell, query_id, embedding) and (cell, id, embedding). Where the number
    of ``cells`` is known, it is at most MAX_CELLS, and their sizes go to every task;
    otherwise they are joined as the run-time statistics advise."""
    cores = max(1, vectors.sparkSession.sparkContext.defaultParallelism // cells) if cells else 1
    asked = questions.groupBy("cell").agg(_blocks(F.count("*"), QUESTION_BLOCK).alias("q_blocks"))
    held = vectors.groupBy("cell").agg(_blocks(F.count("*"), VECTOR_BLOCK, cores).alias("v_blocks"))
    blocks = asked.join(held, "cell")
    blocks = F.broadcast(blocks) if cells else apart(blocks)
    return _search_blocks(questions.join(blocks, "cell"), vectors.join(blocks, "cell"), k)


def _search_all(questions: DataFrame, vectors: DataFrame, k: int, n_vectors: int) -> DataFrame:
    """The same for one cell: counts take the place of joins."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = [
        F.lit(0).alias("cell"),
        _blocks(F.lit(questions.count()), QUESTION_BLOCK).alias("q_blocks"),
        _blocks(F.lit(n_vectors), VECTOR_BLOCK, cores).alias("v_blocks"),
    ]
    return _search_blocks(questions.select("*", *sizes), vectors.select("*", *sizes), k)


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )


def _distances(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row's vector to each pivot."""
    x = _matrix(pa.chunked_array([batch.column("embedding")]))
    if not len(x):
        return np.empty((0, len(pivots)))
    square = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def _without_copies(batch: pa.RecordBatch, key: str, k: int | None) -> pa.RecordBatch:
    """A third of a corpus may be copies of one vector: all but k of a batch go here,
    before anything is shuffled. ``k`` is None for questions, which all count."""
    if k is None or not batch.num_rows:
        return batch
    x = _matrix(pa.chunked_array([batch.column("embedding")]))
    return batch.take(pa.array(_first_copies(x, batch.column(key), k)))


def _with_cell(rows: DataFrame, key: str, pivots, k: int | None = None) -> DataFrame:
    """``cell, key, embedding, to_pivot``: each row with its nearest pivot."""
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            rows.schema[key],
            rows.schema["embedding"],
            T.StructField("to_pivot", T.DoubleType()),
        ]
    )

    def assign(batches):
        for batch in batches:
            batch = _without_copies(batch, key, k)
            d = _distances(batch, pivots.value)
            cell = d.argmin(axis=1) if len(d) else np.empty(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)),
                    batch.column(key),
                    batch.column("embedding"),
                    pa.array(d[np.arange(len(d)), cell]),
                ],
                names=["cell", key, "embedding", "to_pivot"],
            )

    return rows.select(key, "embedding").mapInArrow(assign, schema)


def _cells_in_reach(questions: DataFrame, pivots, radii: dict[int, float]) -> DataFrame:
    """``cell, query_id, embedding`` for each further cell that may hold a neighbour.

    With r the cell's radius, p its pivot, h the question's nearest pivot and b the
    bound on the k-th distance, a cell is out of reach if d(q,p) − r > b, or if the
    hyperplane between p and h is further than b from the question.
    """
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            questions.schema["query_id"],
            questions.schema["embedding"],
        ]
    )

    def probe(batches):
        p = pivots.value
        between = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2), 0.0))
        radius = np.array([radii.get(i, -np.inf) for i in range(len(p))])
        for batch in batches:
            d = _distances(batch, p)
            if not len(d):
                continue
            home = batch.column("cell").to_numpy()
            bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None] + 1e-6
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2.0 * between[home])
            reach = (d - radius <= bound) & ~(plane > bound)
            reach[np.arange(len(d)), home] = False
            rows, cells = np.nonzero(reach)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), taken.column("query_id"), taken.column("embedding")],
                names=["cell", "query_id", "embedding"],
            )

    return questions.mapInArrow(probe, schema)


def knn(questions: DataFrame, vectors: DataFrame, k: int, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact k nearest vectors: ``query_id, rank, id, distance``, ties by id.

    ``questions`` is (query_id, embedding), ``vectors`` is (id, embedding). Broken vectors
    on either side take no part, see :func:`rejected`.
    """
    spark = vectors.sparkSession
    questions, vectors = _sound_sides(questions, vectors)
    n = vectors.count()
    cells = min(MAX_CELLS, n // cell_rows)
    if cells < 2:
        return _rank(_search_all(questions, vectors, k, n), k)
    # At most MAX_CELLS vectors, chosen by hash, come to the driver.
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(cells).select("embedding").collect()
    pivots = spark.sparkContext.broadcast(np.unique(np.array([row[0] for row in chosen], dtype=np.float64), axis=0))
    corpus = cut_lineage(_with_cell(vectors, "id", pivots, k))
    asked = cut_lineage(_with_cell(questions, "query_id", pivots))
    radii = {row[0]: row[1] for row in corpus.groupBy("cell").agg(F.max("to_pivot")).collect()}
    home = cut_lineage(_rank(_search_cells(asked, corpus, k, cells=cells), k))
    full = home.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
    bounded = asked.join(full, "query_id", "left").select(
        "cell",
        "query_id",
        "embedding",
        F.when(F.col("n") == k, F.col("worst")).otherwise(F.lit(float("inf"))).alias("bound"),
    )
    further = _search_cells(cut_lineage(_cells_in_reach(bounded, pivots, radii)), corpus, k, cells=cells)
    return _rank(home.select("query_id", "id", "distance").unionByName(further), k)


def _with_buckets(
    rows: DataFrame, key: str, planes, tables: int, bucket_length: float, k: int | None = None
) -> DataFrame:
    """``cell, key, embedding``: each row once per hash table. A table's bucket is a
    tuple of quantised projections, mixed into one number; should two tuples meet, the
    search only has more to measure."""
    schema = T.StructType([T.StructField("cell", T.LongType()), rows.schema[key], rows.schema["embedding"]])

    def hashed(batches):
        projection, shift, mix = planes.value
        for batch in batches:
            batch = _without_copies(batch, key, k)
            x = _matrix(pa.chunked_array([batch.column("embedding")]))
            if not len(x):
                continue
            steps = np.floor((x @ projection + shift) / bucket_length).astype(np.int64)
            with np.errstate(over="ignore"):
                cells = (steps * mix).reshape(len(x), tables, -1).sum(axis=2) * tables + np.arange(tables)
            for at in range(0, len(x), SENT_ROWS):
                part = cells[at : at + SENT_ROWS]
                again = batch.take(pa.array(np.repeat(np.arange(at, at + len(part)), tables)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel()), again.column(key), again.column("embedding")],
                    names=["cell", key, "embedding"],
                )

    return rows.select(key, "embedding").mapInArrow(hashed, schema)


def knn_lsh(
    questions: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    tables: int = 8,
    width: int = 3,
    bucket_length: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Approximate k nearest vectors by locality-sensitive hashing for L2 distance.

    ``width`` projections together make a bucket, so that far vectors rarely meet;
    ``tables`` independent bucketings make it likely that near ones do. A question sees
    only vectors that share one of its buckets; questions that meet fewer than k go on to
    the exact search.
    """
    spark = vectors.sparkSession
    questions, vectors = _sound_sides(questions, vectors)
    first = vectors.select(F.size("embedding").alias("n")).first()
    rng, n = np.random.default_rng(seed), tables * width
    projection = rng.normal(size=(first["n"] if first else 1, n))
    odd = rng.integers(1, 2**62, size=n, dtype=np.int64) * 2 + 1
    planes = spark.sparkContext.broadcast((projection / np.linalg.norm(projection, axis=0), rng.random(n) * bucket_length, odd))
    found = _search_cells(
        _with_buckets(questions, "query_id", planes, tables, bucket_length),
        _with_buckets(vectors, "id", planes, tables, bucket_length, k),
        k,
    )
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    ranked = cut_lineage(_rank(once, k))
    full = ranked.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    few = cut_lineage(questions.join(apart(full), "query_id", "left_anti"))
    if few.isEmpty():
        return ranked
    return ranked.join(apart(full), "query_id", "left_semi").unionByName(knn(few, vectors, k))


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate search found, per question."""
    hits = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(hits, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
