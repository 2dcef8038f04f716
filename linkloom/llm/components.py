"""Connected components of a graph of pairs, in rounds over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch

EDGES = "a long, b long"


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, root)
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        members = list(self.parent)
        roots = [self.find(x) for x in members]
        return pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def contract(batches: Iterator[pa.RecordBatch], held: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest members; components stay as they are."""
    forest = Forest()
    for b in batches:
        pairs = np.unique(np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], axis=1), axis=0)
        for x, y in pairs.tolist():
            forest.union(x, y)
        if len(forest.parent) > held:
            yield forest.stars()
            forest = Forest()
    yield forest.stars()


def tangled(edges: DataFrame) -> bool:
    """Whether different edges are no stars yet: some node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(nodes.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).head()[0])


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, component (the smallest member) for every node of an edge a - b between different nodes.

    Each task makes its edges stars around the smallest members. Two kinds of
    rounds alternate until all edges together are: each node hands its larger
    neighbours, then its smaller ones, to the smallest neighbour. The
    number of rounds grows with the logarithm of a component's size; edges never
    gather in one task, as a node's smallest neighbour is a partial aggregate
    and the join to it may split a large node.
    """
    edges = scratch.save(edges.mapInArrow(contract, EDGES).where("a <> b").distinct(), f"{label}-0")
    k = 0
    while tangled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        k += 1
        edges = scratch.save(small.distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
