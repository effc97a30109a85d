"""Connected components of a large graph by large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import apart, cut_lineage

EDGES = "u long, v long"


def _hooked(near: DataFrame) -> DataFrame:
    """``near`` (u, v) with ``m``, the least of ``u`` and all its ``v``."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(apart(least), "u")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the same components that lead from each node to its least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        hooked = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(hooked, end, least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == root).all():
            break
        root = hooked
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with those of each task made stars, a part of the shuffle at a time."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            u, v = stars(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.distinct().mapInArrow(contract, EDGES)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none where one leads to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    ways = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return ways.filter("down > 1 or (down = 1 and n > 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (columns ``a``, ``b``), ``root`` being the
    least node of its component. A node's neighbours are only ever reduced to their minimum,
    so a hot node needs no task of its own; rounds grow with the logarithm of the diameter,
    and edges that meet in a task are made one step."""
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut_lineage(_contracted(ends))
    while not _settled(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _hooked(large)
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = cut_lineage(_contracted(joined.filter("u <> v")))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
