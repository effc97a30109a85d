"""The index of cells against the exact search."""

import numpy as np
import pytest

from lorekeep.operators import cells, knn

SCHEMA = "id long, embedding array<float>"


def clustered(spark, n, seed, size=32, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, size))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], SCHEMA)


def asked_of(vectors, every):
    return vectors.filter(f"id % {every} = 0").selectExpr("id as query_id", "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def compared(lists, model, questions):
    """Share of the corpus whose codes a question looks at."""
    from lorekeep.operators.knn import _matrix

    sizes = np.zeros(len(model.centres))
    for r in lists.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    x = _matrix(questions.select("embedding").toArrow()["embedding"])
    d = ((x[:, None] - model.centres) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1)[:, : model.probes]
    return sizes[near].sum(axis=1).mean() / sizes.sum()


def test_recall_and_share(spark):
    """Recall of 0.9 and more, over a share of the corpus that falls as it grows."""
    shares = []
    for n in (2_000, 20_000):
        vectors = clustered(spark, n, 3, groups=n // 50).cache()
        questions = asked_of(vectors, n // 100)
        lists, model = cells.build_cells(vectors)
        assert lists.count() == n
        exact, found = knn.knn(questions, vectors, 4), cells.search_cells(questions, vectors, lists, model, 4)
        recall = knn.recall_at_k(found, exact).agg({"recall": "avg"}).first()[0]
        assert recall >= 0.9
        assert found.groupBy("query_id").count().filter("count <> 4").isEmpty()
        shares.append(compared(lists, model, questions))
        vectors.unpersist()
    assert shares[1] < shares[0] / 2 and shares[1] < 0.05


def test_distances_are_exact(spark):
    vectors = clustered(spark, 1500, 5)
    questions = asked_of(vectors, 50)
    lists, model = cells.build_cells(vectors)
    everything = cells.search_cells(questions, vectors, lists, model, 5, probes=len(model.centres), shortlist=2000)
    assert rows(everything) == rows(knn.knn(questions, vectors, 5))


def test_probes_are_raised_until_k_are_found(spark):
    vectors = clustered(spark, 300, 6)
    lists, model = cells.build_cells(vectors)
    found = cells.search_cells(asked_of(vectors, 100), vectors, lists, model, 200, probes=1)
    assert found.groupBy("query_id").count().filter("count <> 200").isEmpty()


def test_few_broken_and_repeated_vectors(spark):
    data = [(k, [float(k), 1.0, 0.0]) for k in range(5)] + [(90 + k, [2.0, 1.0, 0.0]) for k in range(4)]
    data += [(50, None), (51, []), (52, [1.0]), (53, [None, 1.0, 1.0]), (54, [float("nan"), 1.0, 1.0])]
    vectors = spark.createDataFrame(data, SCHEMA)
    lists, model = cells.build_cells(vectors)
    assert lists.count() == 9
    questions = spark.createDataFrame([(1, [2.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    assert rows(cells.search_cells(questions, vectors, lists, model, 6)) == rows(knn.knn(questions, vectors, 6))
    nothing = vectors.limit(0)
    lists, model = cells.build_cells(nothing)
    assert cells.search_cells(questions, nothing, lists, model, 3).count() == 0


def test_model_is_stored(spark):
    lists, model = cells.build_cells(clustered(spark, 800, 8))
    back = cells.read_model(cells.model_rows(spark, model))
    assert back.probes == model.probes and (back.centres == model.centres).all() and (back.words == model.words).all()


@pytest.mark.parametrize("size", [1, 3, 5, 32])
def test_codes_are_near(size):
    """The sum of look-ups is the distance to what the code stands for."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size))
    centres = cells.kmeans(x, 6, rng)
    rest = x - centres[cells.nearest(x, centres)[0]]
    words = [cells.kmeans(p, 16, rng) for p in cells._subs(rest)]
    model = cells.Cells(centres, cells._padded(words, max(w.shape[1] for w in words)), 6)
    cell, code = cells.codes(x, model)
    decoded = centres[cell] + np.concatenate([words[k][code[:, k]] for k in range(len(words))], axis=1)
    q = rng.normal(size=size)
    for c in range(6):
        table = cells.tables((q - centres[c])[None], model)[0]
        here = cell == c
        rough = sum(table[k, code[here, k]] for k in range(code.shape[1]))
        assert np.allclose(rough, ((decoded[here] - q) ** 2).sum(axis=1))


def test_rows_follow_parts_and_not_cells(spark):
    """However many cells a question looks into, it travels once to a part and takes back ``top`` rows."""
    vectors = clustered(spark, 3000, 9)
    lists, model = cells.build_cells(vectors)
    parts = cells._parts(lists, len(model.centres))
    assert sum(parts.rows) == 3000 and 4 * len(parts.members) < len(model.centres)
    shared = spark.sparkContext.broadcast((model, parts))
    probed = cells._probed(asked_of(vectors, 100), shared, len(model.centres)).cache()
    assert probed.count() == 30 * len(parts.members)
    assert cells._shortlisted(probed, lists.select("cell", "id", "code"), shared, parts, 4).count() == 4 * probed.count()


def test_cells_in_many_blocks(spark, monkeypatch):
    """Cells larger than a part, several blocks of questions, and copies of one vector."""
    monkeypatch.setattr(cells, "CODE_BLOCK", 20)
    monkeypatch.setattr(cells, "QUESTION_BLOCK", 8)
    some = clustered(spark, 400, 11, size=8, groups=4)
    vectors = some.unionByName(some.filter("id = 7").selectExpr("explode(sequence(1000L, 1060L)) as id", "embedding"))
    lists, model = cells.build_cells(vectors)
    found = cells.search_cells(asked_of(vectors, 7), vectors, lists, model, 5, probes=len(model.centres), shortlist=1000)
    assert rows(found) == rows(knn.knn(asked_of(vectors, 7), vectors, 5))
