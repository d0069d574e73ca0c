"""Connected components: tasks turn blocks of edges into stars around their smallest nodes; more blocks than one are joined by alternating stars, each round a join, a grouping and a checkpoint.

Nulls and odd rows: a null end and a loop make no link, repeated links count once, no links give an empty table; other
columns than the two ends are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import cut

#: Edges that a task turns into stars, about; so many make a block.
EDGES = 1 << 16


class Forest:
    """Union-find over positions, a block of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            if not len(high):
                return
            np.minimum.at(self.root, high, low)
            while not np.array_equal(above := self.root[self.root], self.root):
                self.root = above
            a, b = high, low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and b, the smallest node that the task's edges lead to from it, for each node a of them; of more than 2 * EDGES edges first some, then stars and others."""
    held: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(ends.shape)
        trees = Forest(len(nodes))
        trees.link(a, b)
        return nodes, nodes[trees.root] if len(nodes) else nodes

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
        if sum(x.shape[1] for x in held) > 2 * EDGES and len(held) > 1:
            held = [np.stack(merged())]
    nodes, roots = merged()
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def _settled(now: DataFrame) -> bool:
    """Whether every node has one link upwards at most, to a node that has none: then all links lead to roots."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root` for every node of an edge: root is the smallest node that it can reach.

    Null ends and loops are left out; no edges give an empty table. Up to EDGES edges are one block, whose stars are the
    components. Stars of more blocks go through rounds, which end when every link leads to a root; a hub's edges are met by
    its one minimum, so no pair of a hub's neighbours is ever formed.
    """
    now = cut(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct())
    blocks = -(-now.count() // EDGES)
    stars = now.coalesce(max(1, blocks)).mapInArrow(_stars, "a long, b long")
    if blocks <= 1:
        return cut(stars).toDF("node", "root")
    now = cut(stars.where("a <> b").distinct())
    while not _settled(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        little = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(little.union(least.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
