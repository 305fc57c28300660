"""Connected components of an undirected graph given by its edges.

Large-star and small-star steps alternate until nothing changes (two published operations on minimum
labels); each is a grouped minimum and a join, so a node with very many neighbours is summed
before the shuffle. The join's key is not that of the minimum, so both of its sides come by an exchange of
their own, and adaptive execution can split the edges of such a node among tasks. Edges are written between rounds: lineage stays
short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import stored


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        """Root of every member, by pointer jumping."""
        parent = np.array(self.parent, np.int64)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent = up


class Classes:
    """Classes of 0..n-1 with the label of every member at hand; of two that are joined the smaller is labelled anew."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        left, right = self.members.get(a, [a]), self.members.pop(b, [b])
        if len(left) < len(right):
            self.members.pop(a, None)
            a, b, left, right = b, a, right, left
        self.label[right] = a
        left.extend(right)
        self.members[a] = left
        return True


def forest_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its local component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(names))
    n = len(a)
    for x, y in zip(at[:n].tolist(), at[n:].tolist()):
        forest.join(x, y)
    roots = forest.roots()
    other = np.flatnonzero(roots != np.arange(len(names)))
    return names[other], names[roots[other]]


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with m, the smallest neighbour of their a; and (x, m) of every node a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
    sides = edges.withColumn("key", F.bitwise_not("a")), least.select(F.bitwise_not("x").alias("other"), "m")
    return sides[0].join(sides[1], F.col("key") == F.col("other")).select("a", "b", "m"), least


def _large_star(edges: DataFrame) -> DataFrame:
    met, _ = _with_least(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    met = met.withColumn("m", F.least("a", "m"))
    return met.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    met, least = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    own = least.select(F.col("x").alias("a"), F.col("m").alias("b"))
    return own.union(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of a task's edges, half a million at a time."""
    held, size = [], 0

    def forest():
        a, b = forest_edges(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
        if size > 500_000:
            yield forest()
            held, size = [], 0
    if held:
        yield forest()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; edges has columns a and b.

    The edges of a node meet in one task first, which drops those that other tasks found as well.
    """
    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stored(edges.filter("a <> b").select("a", "b").repartition("a").mapInArrow(_local, "a long, b long"), name)
    seen = mark(now)
    while seen[0]:
        now = stored(_small_star(_large_star(now)), name)
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
