"""Operators 12 and 13 against plain readings of their contracts."""

import hashlib
import math

import numpy as np
import pytest

from lorekeep.llm import caps, centroids
from lorekeep.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def table_of(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def rows_of(x):
    return [(k, [float(v) for v in row], 0) for k, row in enumerate(x.astype(np.float32))]


def broken(size=64):
    good = [0.5] * size
    return [
        (None, good, 1), (900, None, 1), (901, [], 1), (902, [0.0] * size, 1), (903, [math.nan] + good[1:], 1), (904, [None] + good[1:], 1),
        (905, [math.inf] + good[1:], 1), (906, good[:5], 1), (907, good[:5], 1), (908, good, None), (908, good, 2), (None, None, None),
        (909, [-0.5] * size, 1), (None, [float(k == 3) for k in range(size)], 1),
    ]


def clusters_by_hand(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e, _ in rows if e and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    centres = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [x for (_, x), f in zip(kept, found) if f[1] == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    inertia = [sum(d for d, c in found if c == n) for n in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], total, name[c]) for (i, _), (d, c) in zip(kept, found))


def links_by_hand(rows, least=0.95):
    ok = lambda e: e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    units = [np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) if ok(e) else None for _, e, _ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in near[i])])
            changed |= low < root[i]
            root[i] = low
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((str(rows[i][0]), len(near[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple([str(r.vec_id), r.n_links, r.component_id, r.kept]) for r in df.collect()), key=str)


def groups(rng, sizes, noise, size=64):
    """Groups of near copies around random directions, and some vectors alone."""
    x = []
    for n, spread in zip(sizes, noise):
        c = rng.normal(size=size)
        x.append(c / np.linalg.norm(c) + spread * rng.normal(size=(n, size)) / math.sqrt(size))
    return np.concatenate(x)


def test_clusters(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = rows_of(groups(rng, [60, 30, 1, 1, 9], [0.4, 0.9, 0, 0, 0.2])) + broken()
    df = QUERIES["op12_centroid_clusters"](spark, table_of(spark, rows, tmp_path))
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in df.collect())
    assert got == clusters_by_hand(stored)


def test_few_and_no_vectors(spark, tmp_path):
    for n in (0, 3):
        rows = rows_of(np.random.default_rng(n).normal(size=(n, 64)))
        df = QUERIES["op12_centroid_clusters"](spark, table_of(spark, rows, tmp_path / str(n)))
        assert sorted((str(r[0]), *r[1:]) for r in df.collect()) == clusters_by_hand(rows)
        assert QUERIES["op13_near_vectors"](spark, str(tmp_path / str(n))).count() == n


def test_ties_go_to_the_first(spark):
    rows = [(k, [float(k % 2)] * 4, 0) for k in range(40)]
    got = {r.vec_id: r.cluster for r in centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=5, size=4).collect()}
    assert len({got[k] for k in range(0, 40, 2)}) == 1 and len({got[k] for k in range(1, 40, 2)}) == 1


def test_only_changed_columns_are_read():
    x = np.arange(12).reshape(3, 4)
    old, new = np.array([[0, 1, 2, 3], [5, 5, 5, 5]]), np.array([[0, 1, 9, 3], [5, 5, 5, 5]])
    dots = x @ old.T
    places = np.flatnonzero((new - old)[0])
    dots[:, 0] += x[:, places] @ (new - old)[0, places]
    assert (dots == x @ new.T).all() and len(places) == 1
    _, distance = centroids.nearest((x * x).sum(axis=1), dots, new)
    assert (distance == ((x[:, None] - new) ** 2).sum(axis=2).min(axis=1)).all()


def test_beyond_the_largest(spark):
    rows = [(1, [2.0e6] * 4, 0)]
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), size=4).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_links(spark, tmp_path, seed):
    """Tight groups, groups at the threshold (0.95 is a spread of about 0.32), chains, copies."""
    rng = np.random.default_rng(seed)
    x = groups(rng, [90, 80, 40, 20, 1, 1, 1], [0.1, 0.22, 0.3, 0.33, 0, 0, 0])
    a, b = (v / np.linalg.norm(v) for v in np.linalg.qr(rng.normal(size=(64, 2)))[0].T)
    chain = np.array([math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 2.4, 0.2)])
    rows = rows_of(np.concatenate([x, chain, 7.5 * x[:5]])) + broken()
    rows += [(5000 + k, rows[3][1], 9) for k in range(4)]
    df = QUERIES["op13_near_vectors"](spark, table_of(spark, rows, tmp_path))
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    want = links_by_hand(stored)
    got = found(df)
    assert len(got) == len(want) and [g[0] for g in got] == [w[0] for w in want]
    assert got == want


def test_large_components_and_full_lists(spark, monkeypatch):
    """Shells, blocks and larger codes, with bounds that small data reach."""
    monkeypatch.setattr(caps, "GROUP", 10)
    monkeypatch.setattr(caps, "COMPARED", 16)
    monkeypatch.setattr(caps, "LIST", 3)
    rng = np.random.default_rng(7)
    x = groups(rng, [70, 60, 50, 30], [0.12, 0.25, 0.31, 0.34])
    cloud = rng.normal(size=64) / 8 + rng.normal(size=(60, 64)) / 14
    rows = rows_of(np.concatenate([x, cloud]))
    assert found(caps.near_vectors(spark.createDataFrame(rows, SCHEMA))) == links_by_hand(rows)


@pytest.mark.parametrize("size", [2, 8, 20, 48, 300])
def test_other_sizes(spark, size):
    rng = np.random.default_rng(size)
    spread = 0.15
    rows = rows_of(groups(rng, [12] * 4 + [1] * 10, [spread] * 4 + [0] * 10, size))
    assert found(caps.near_vectors(spark.createDataFrame(rows, SCHEMA))) == links_by_hand(rows)


@pytest.mark.parametrize(("words", "recall"), [(16, 0.999), (32, 0.999)])
def test_recall_at_the_threshold(words, recall):
    """The chance that two vectors with a cosine of exactly 0.95 list a direction in common."""
    rng = np.random.default_rng(5)
    n = 5000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (a, fa), (b, fb) = caps.listed(x, words), caps.listed(y, words)
    both = {(i, f) for i, f in zip(a.tolist(), fa.tolist())} & {(i, f) for i, f in zip(b.tolist(), fb.tolist())}
    assert len({i for i, _ in both}) / n >= recall
    differ = np.bitwise_count((caps.plane_bits(x) ^ caps.plane_bits(y)).view(np.uint64)).sum(axis=1)
    p = math.acos(0.95) / math.pi
    assert differ.max() <= 128 * p + caps.DEVIATIONS * math.sqrt(128 * p * (1 - p))


def test_extra_columns(spark):
    names = ["cls", "e", "root", "unit", "direction", "component_id", "n_links", "x", "cluster", "label"]
    rows = [(k, [float(k), 1.0, 2.0, 3.0], *names) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"{n} string" for n in names))
    assert found(caps.near_vectors(df)) == links_by_hand([(r[0], r[1], 0) for r in rows])
    assert centroids.cluster_vectors(df, k=2, size=4).count() == 6
