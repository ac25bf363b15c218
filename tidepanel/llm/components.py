"""Connected components of an edge table by alternating stars; nothing of it passes through the driver but three counts a round."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: up to so many edges one task solves alone (16 bytes each); more go in rounds of joins
SMALL = 300_000


def forest_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node that each can reach."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x
    for x, y in zip(place[:len(a)].tolist(), place[len(a):].tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return ids, ids[np.fromiter(map(top, range(len(ids))), np.int64, len(ids))]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    node, root = forest_roots(*(np.concatenate([p[i] for p in parts]) for i in (0, 1))) if parts else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any integer type, in either direction, repeats and loops allowed -> (node, root), root the least node reachable.

    A small table of distinct edges (``SMALL``) is solved by one task. In a larger one each round hangs every node's larger neighbours on the least node it knows, then the smaller ones; depth falls by a constant
    factor. A hub never becomes a group: rows meet its minimum in a join, which adaptive execution may split.
    Nodes without an edge to another node are not returned; an empty table gives an empty table.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = cut(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        if mark is None and seen[0] <= SMALL:
            return now.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).coalesce(1).mapInArrow(_solve, "node bigint, root bigint")
        mark = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(*pair(F.col("b"), F.col("m"))).union(low.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
