"""Connected components of a distributed table of links, by alternating star operations.

Each partition first reduces its links to a forest with union-find. Forests of a bounded number of links
together are united by one more union-find; beyond that bound, large-star and small-star rounds point every node at its smallest neighbour until nothing changes. Every round is a partial
aggregation and a join on the node, whose hubs adaptive execution splits; each round's links are
written to the shared folder, so that a lost executor costs a read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.shared import written


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root and up != x:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Links that one union-find holds before it passes its forest on and starts anew, to bound memory.
FOREST_NODES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out() -> pa.RecordBatch:
        own = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        a, b = zip(*own, strict=True) if own else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > FOREST_NODES:
            yield out()
            forest = Forest()
    yield out()


def connected(links: DataFrame) -> DataFrame:
    """links(a long, b long) to (node, root): the smallest node reachable from each node that has a link to another."""
    edges = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(edges.mapInArrow(_forest, "a long, b long"), "links")  # a > b from here on
    if edges.count() <= FOREST_NODES // 2:  # one forest holds what is left: its trees are the components
        return _named(written(edges.coalesce(1).mapInArrow(_forest, "a long, b long"), "links"))
    known = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        large = written(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        small = large.join(low, F.col("a") == F.col("node")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(low.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state == known or not state[0]:
            return _named(edges)
        known = state


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", F.col("b").alias("root")).distinct())
