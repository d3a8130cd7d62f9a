"""Connected components of an edge table: in one task up to a proven number of edges, beyond it in rounds that each halve the depth of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.shared import bound_batches, dropped, written

#: Edges up to which one task joins them (16 bytes each); the rounds give the same result.
ONE_TASK = 200_000
#: Edges up to which the least neighbours, of which there are no more, are broadcast (16 bytes each).
MOST_BROADCAST = 500_000


def _lowest(edges: DataFrame, n: int) -> DataFrame:
    """The least smaller neighbour of each node that has one. Edges lead from larger to smaller."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return F.broadcast(low) if n <= MOST_BROADCAST else low


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang each node's larger neighbours below its least neighbour. A node without a smaller one keeps them: its edges need no partner, however many they are."""
    low = _lowest(edges, n).withColumnRenamed("a", "b")
    return edges.join(low, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang each node, with its smaller neighbours, below the least of them."""
    low = _lowest(edges, n)
    rest = edges.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.union(low.select("a", F.col("low").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


class Sets:
    """Disjoint sets of numbers, each named by its least."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while x != root:
            up[x], x = root, up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether ``x`` and ``y`` were apart."""
        x, y = self.find(x), self.find(y)
        low, high = (x, y) if x < y else (y, x)
        self.up[high], self.up[low] = low, low
        return x != y


def _in_one_task(edges: DataFrame) -> DataFrame:
    bound_batches(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                sets.join(a, b)
        nodes = [*sets.up]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.select("a", "b").where("a <> b").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component) of every node in ``edges`` (a long, b long; a table that ``written`` gave): ``component`` is the smallest node that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes; the edges stay in tables between the rounds.
    Self-loops and nulls are dropped.
    """
    if edges.count() <= ONE_TASK:
        return written(_in_one_task(edges), name)
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(oriented, name)
    mark = _mark(now)
    while True:
        new = written(_small_star(_large_star(now, mark[0]), mark[0]), name)
        dropped(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
