"""Centroid clustering over an incremental distance matrix (operator 12).

Vectors become integers, so every sum and distance is exact and results do not depend on how
rows are dealt. Each vector keeps a row of the distance matrix: its dot products with all
centroids. A round moves the centroids; a dot product then changes by the vector's components at
the places where its centroid changed, times the change. Only those columns are read, and a
centroid that stays costs nothing. The squared distance is the vector's norm, less twice the dot
product, and the centroid's norm.

Every round is one narrow map, written to the shared folder, and a sum per cluster that is taken
within each task first. The driver holds the centroids, the counts and sums of the clusters: a
few numbers a cluster and dimension, whatever the input. No row is shuffled, so no value is hot.

Defined cases: vectors that are null, of another size, or with components that are null or not
finite are left out of the result. Repeated rows are vectors of their own, also as first
centroids; among equal ids the vector that sorts first comes first. A null ``vec_id`` counts as
an empty one in the hash. Fewer vectors than clusters are a cluster each; no vectors give no
rows. Components beyond ``LARGEST`` units are an error, as a distance would no longer be a long.
Columns other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import small_batches
from lorekeep.session import cut_lineage

# Fixed values of the contract of operator 12.
SIZE = 64
UNITS = 64
CLUSTERS = 16
ROUNDS = 3
SALT = "1:"

# Squared distances of such components over 2^10 dimensions are below 2^63.
LARGEST = 1 << 26


def quantised(rows: DataFrame, size: int = SIZE, units: int = UNITS) -> DataFrame:
    """``vec_id, x``: the vectors with ``size`` finite components, each as floor(units * it)."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    sound = (F.size("embedding") == size) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def steps(v: Column) -> Column:
        beyond = F.raise_error(F.lit(f"a component beyond {LARGEST} units")).cast("int")
        scaled = F.floor(v * float(units))
        return F.when(F.abs(v) * units >= LARGEST, beyond).otherwise(scaled.cast("int"))

    return rows.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(wide, steps).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel(), kind.value_type))


def nearest(norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, of several the first, and the squared distance."""
    distance = norms[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(cluster)), cluster]


def _assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``rows`` with their dot products brought from the centroids ``before`` (None: from none)
    to ``centroids``, and the nearest of these."""
    kinds = T.StructType.fromDDL("norm long, dots array<long>, cluster int, distance long")
    schema = T.StructType([*(rows.schema[c] for c in ("vec_id", "x")), *kinds.fields])
    form = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    k, size = centroids.shape
    change = centroids if before is None else centroids - before
    changed = [np.flatnonzero(c) for c in change]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            norms = (x * x).sum(axis=1) if before is None else batch.column(2).to_numpy()
            dots = np.zeros((len(x), k), np.int64) if before is None else _matrix(batch.column(3), k)
            for c, places in enumerate(changed):
                if len(places):
                    dots[:, c] += x[:, places] @ change[c, places]
            cluster, distance = nearest(norms, dots, centroids)
            columns = [*batch.columns[:2], pa.array(norms), _lists(dots, form.field("dots").type), pa.array(cluster, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, schema=form)

    return rows.select(*schema.names[: 2 if before is None else 4]).mapInArrow(assign, schema)


def _sums(rows: DataFrame, k: int, size: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Per cluster the number of vectors, the sum of their components and of their distances.
    A task sends a row a cluster; the sums of tasks are exact decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (size + 2) for _ in range(k)]
        for batch in batches:
            x, cluster = _matrix(batch.column(0), size), batch.column(1).to_numpy()
            wide = np.column_stack([np.ones(len(x), np.int64), batch.column(2).to_numpy() >> 31, batch.column(2).to_numpy() & (1 << 31) - 1, x])
            for c in np.unique(cluster):
                n, high, low, *parts = map(int, wide[cluster == c].sum(axis=0))
                totals[c] = [a + b for a, b in zip(totals[c], [n, (high << 31) + low, *parts])]
        at = [(c, j, str(v)) for c, row in enumerate(totals) if row[0] for j, v in enumerate(row)]
        c, j, v = zip(*at) if at else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.string())], names=["c", "j", "v"])

    parts = rows.select("x", "cluster", "distance").mapInArrow(add, "c int, j int, v string")
    total = parts.groupBy("c", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    counts, sums, inertia = [0] * k, [[0] * size for _ in range(k)], [0] * k
    for c, j, v in total.collect():  # k * (size + 2) rows at most
        if j == 0:
            counts[c] = int(v)
        elif j == 1:
            inertia[c] = int(v)
        else:
            sums[c][j - 2] = int(v)
    return counts, sums, inertia


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors with the least hash of their ids."""
    name = F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = vectors.orderBy(F.sha2(name, 256), "x").limit(k).select("x").collect()
    return np.array([r.x for r in chosen], np.int64)


def cluster_vectors(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, units: int = UNITS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector, after
    ``rounds`` of assignment and of moving each centroid to the floor of its cluster's mean."""
    spark = rows.sparkSession
    small_batches(spark, 10_000)
    vectors = cut_lineage(quantised(rows, size, units))
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        empty = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(RESULT).fields])
        return spark.createDataFrame([], empty)
    before = None
    for _ in range(rounds):
        vectors = cut_lineage(_assigned(vectors, centroids, before))
        counts, sums, _ = _sums(vectors, *centroids.shape)
        moved = [[v // n for v in total] if n else old for n, total, old in zip(counts, sums, centroids.tolist())]
        before, centroids = centroids, np.array(moved, np.int64)
    vectors = cut_lineage(_assigned(vectors, centroids, before))
    _, _, inertia = _sums(vectors, *centroids.shape)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return vectors.select(
        "vec_id",
        "cluster",
        "distance",
        pick(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        pick(names).alias("centroid_sha256"),
    )


RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
