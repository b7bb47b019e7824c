"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


class UnionFind:
    """Disjoint sets with path halving; the smallest member is each set's root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition reduced to (member, smallest member) pairs."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
    nodes = [x for x in sets.parent if sets.find(x) != x]
    roots = [sets.find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"]
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star contraction of (node, root) edges with root < node."""
    if large:
        sym = edges.union(edges.select("root", "node"))
        least = sym.groupBy("node").agg(F.min("root").alias("least"))
        # Neighbours above a node point to the least of its neighbourhood.
        out = sym.join(least, "node").where(F.col("root") > F.col("node"))
        out = out.select(
            F.col("root").alias("n"), F.least("node", "least").alias("r")
        )
    else:
        least = edges.groupBy("node").agg(F.min("root").alias("least"))
        out = edges.join(least, "node").select(F.col("root").alias("n"), F.col("least").alias("r"))
        out = out.union(least.select("node", "least"))
    return out.where("n <> r").distinct().toDF("node", "root")


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that isn't the smallest of its component.

    links has two long columns; a link with a null end is none. Partition-local
    union-find first shrinks the links to forests; alternating large and small
    star contractions then run until the edges stay the same.
    """
    a, b = links.columns
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("long"), F.col(b).cast("long")
    )
    edges = materialise(edges.mapInArrow(_forest, "node long, root long"))
    seen = None
    while True:
        size = edges.agg(
            F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))
        ).first()
        if size == seen or not size[0]:
            return edges
        seen = size
        before, edges = edges, materialise(_star(_star(edges, large=True), large=False))
        discard(before)
