"""Search against brute force, also where cells and blocks are cut up."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import knn as kn

SCHEMA = "id long, embedding array<float>"


def table(spark, matrix, key="id"):
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(matrix)]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", key)


def brute(questions, vectors, k):
    q, v = np.float32(questions).astype(float), np.float32(vectors).astype(float)
    out = {}
    for n, x in enumerate(q):
        d = np.sqrt(((v - x) ** 2).sum(axis=1))
        out[n] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(v)), d))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


def same(got, want):
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    for q, rows in want.items():
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in rows], abs=1e-12)


@pytest.fixture(scope="module")
def clustered():
    """Clusters, with a third of all vectors copies of one."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 4
    points = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.2
    points[::3] = points[0]
    return points, np.vstack([points[:40] + 0.01, rng.normal(size=(10, 8)) * 4])


@pytest.mark.parametrize("cell_rows", [10**9, 60, 20])
def test_exact(spark, clustered, cell_rows):
    points, questions = clustered
    got = found(kn.knn(table(spark, questions, "query_id"), table(spark, points), 4, cell_rows=cell_rows))
    same(got, brute(questions, points, 4))


def test_exact_in_small_blocks(spark, clustered, monkeypatch):
    points, questions = clustered
    monkeypatch.setattr(kn, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(kn, "VECTOR_BLOCK", 50)
    for cell_rows in (10**9, 60):
        got = found(kn.knn(table(spark, questions, "query_id"), table(spark, points), 4, cell_rows=cell_rows))
        same(got, brute(questions, points, 4))


def test_fewer_vectors_than_k(spark):
    points = np.eye(3)
    same(found(kn.knn(table(spark, points, "query_id"), table(spark, points), 5)), brute(points, points, 5))
    wide = np.eye(8)
    same(
        found(kn.knn(table(spark, wide, "query_id"), table(spark, wide), 9, cell_rows=2)),
        brute(wide, wide, 9),
    )


def test_cells_are_skipped(spark, clustered):
    """Clustered data is the point of cells: most of them are out of reach."""
    points, _ = clustered
    pivots = spark.sparkContext.broadcast(np.unique(np.float32(points[1:40:2]).astype(float), axis=0))
    corpus = kn._with_cell(table(spark, points), "id", pivots)
    asked = kn._with_cell(table(spark, points[:50], "query_id"), "query_id", pivots)
    radii = {r[0]: r[1] for r in corpus.groupBy("cell").agg(F.max("to_pivot")).collect()}
    n = kn._cells_in_reach(asked.withColumn("bound", F.lit(0.5)), pivots, radii).count()
    assert n < 50 * (len(pivots.value) - 1) / 3


def test_ranks_are_dense(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").alias("id"), "embedding")
    exact = kn.knn(vectors.withColumnRenamed("id", "query_id"), vectors, 4)
    ranks = exact.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    assert ranks.filter(F.col("r") != F.array(*[F.lit(n) for n in (1, 2, 3, 4)])).count() == 0


def test_lsh_recall(spark, small, clustered):
    """The given vectors have no near neighbours to speak of, clustered ones do."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    given = rows.select(F.col("vec_id").alias("id"), "embedding")
    points, _ = clustered
    for vectors, bound in ((given, 0.85), (table(spark, points), 0.95)):
        asked = vectors.withColumnRenamed("id", "query_id")
        exact, got = kn.knn(asked, vectors, 4), kn.knn_lsh(asked, vectors, 4)
        better = got.join(exact.withColumnRenamed("distance", "least"), ["query_id", "rank"]).filter("distance < least - 1e-9")
        assert better.count() == 0
        assert kn.recall_at_k(got, exact).agg(F.avg("recall")).first()[0] >= bound
        assert got.groupBy("query_id", "id").count().filter("count > 1").count() == 0


def test_buckets_keep_far_vectors_apart(spark, clustered):
    points, _ = clustered
    rng = np.random.default_rng(3)
    planes = spark.sparkContext.broadcast(
        (np.linalg.qr(rng.normal(size=(8, 8)))[0][:, :6], rng.random(6), rng.integers(1, 2**62, size=6) * 2 + 1)
    )
    cells = kn._with_buckets(table(spark, points), "id", planes, 2, 1.0)
    assert cells.count() == 1200
    pairs = cells.groupBy("cell").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert pairs < 2 * 600 * 600 / 3


def test_copies_go_early_but_answers_stay(spark, clustered):
    """Of a third of the corpus, k rows per batch are enough for exact answers."""
    points, _ = clustered
    pivots = spark.sparkContext.broadcast(points[:3])
    vectors = table(spark, points).coalesce(1)
    assert kn._with_cell(vectors, "id", pivots, 4).count() <= 400 + 4
    ids = [r["id"] for r in kn._with_cell(vectors, "id", pivots, 4).filter(F.col("id") % 3 == 0).collect()]
    assert sorted(ids) == [0, 3, 6, 9]
    same(found(kn.knn(table(spark, points, "query_id"), vectors, 4)), brute(points, points, 4))


def test_string_ids(spark):
    rows = [(f"d{n % 7}-{n}", [float(n % 5), 1.0]) for n in range(40)]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [2.0, 1.0])], "query_id string, embedding array<float>")
    got = [r["id"] for r in kn.knn(asked, vectors, 3).orderBy("rank").collect()]
    assert got == sorted(i for i, v in rows if v[0] == 2.0)[:3]


def test_broken_vectors(spark):
    schema, nan = "id long, embedding array<float>", float("nan")
    broken = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [nan, 0.0, 0.0]), (5, [None, 1.0, 2.0])]
    rows = spark.createDataFrame([*broken, (6, [1.0, 0.0, 0.0]), (7, [0.0, 2.0, 0.0])], schema)
    asked = rows.withColumnRenamed("id", "query_id")
    for search in (kn.knn, lambda q, v, k: kn.knn_lsh(q, v, k, bucket_length=50.0)):
        got = {(r.query_id, r.rank, r.id) for r in search(asked, rows, 4).collect()}
        assert got == {(6, 1, 6), (6, 2, 7), (7, 1, 7), (7, 2, 6)}
    assert sorted(r.id for r in kn.rejected(rows).collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="2 dimensions"):
        kn.knn(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>"), rows, 1)
    none = spark.createDataFrame([], schema)
    assert kn.knn(asked, none, 2).count() == 0 and kn.knn(none.withColumnRenamed("id", "query_id"), rows, 2).count() == 0


def test_lsh_goes_on_to_exact_search(spark):
    points = np.eye(12) * 100
    same(found(kn.knn_lsh(table(spark, points, "query_id"), table(spark, points), 5)), brute(points, points, 5))


def test_a_block_is_searched_in_little_memory():
    """Products and copies of a block are made in parts: a few times the block and no more."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(16384, 8)).astype(np.float32)
    side = lambda x, key, name: pa.table({key: pa.array(np.arange(len(x))[::-1]), name: pa.array(list(x))})
    sides = side(q, "query_id", "q_block_embedding"), side(v, "id", "v_block_embedding")
    search = kn._block_search(3, pa.int64(), pa.int64())
    tracemalloc.start()
    found = search(None, *sides)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    distance = np.sqrt(((v[None, :, :].astype(float) - q[:20, None, :].astype(float)) ** 2).sum(axis=2))
    want = len(v) - 1 - np.argsort(distance, axis=1, kind="stable")[:, :3]
    assert found["id"].to_numpy().reshape(-1, 3)[:20].tolist() == want.tolist()


def test_rows_of_many_tables_go_on_in_small_batches(spark, monkeypatch):
    """Every row once a hash table, whatever the size of the batches."""
    monkeypatch.setattr(kn, "SENT_ROWS", 3)
    rows = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(10)], "id int, embedding array<double>").coalesce(1)
    rng = np.random.default_rng(1)
    planes = spark.sparkContext.broadcast((rng.normal(size=(2, 6)), rng.random(6), np.ones(6, dtype=np.int64)))
    cells = kn._with_buckets(rows, "id", planes, 3, 0.5)
    assert sorted(r.id for r in cells.collect()) == [n for n in range(10) for _ in range(3)]


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e6), (1e-25, 0.0), (1e25, 0.0)])
def test_few_vectors_of_a_block_are_measured_again(monkeypatch, scale, offset):
    """Products in single precision leave few vectors, also far from the origin, and lose none."""
    rng = np.random.default_rng(5)
    q, v = (rng.normal(size=(n, 16)) * scale + offset for n in (40, 20000))
    v[::50] = v[1] + 1e-9 * scale * rng.normal(size=(400, 16))
    places, measured = [], kn._measured
    monkeypatch.setattr(kn, "_measured", lambda row, near, *rest: (places.append(len(near)), measured(row, near, *rest))[1])
    best, gap = kn._nearest(q, v, 3)
    distance = np.sqrt(((v[None, :, :] - q[:, None, :]) ** 2).sum(axis=2))
    want = np.argsort(distance, axis=1, kind="stable")[:, :3]
    assert best.tolist() == want.tolist()
    assert gap.tolist() == np.take_along_axis(distance, want, axis=1).tolist()
    assert len(places) == 40 and (scale != 1.0 or max(places) < 2000)
