"""Connected components of a link table: alternating large-star and small-star rounds over the cluster, or, while the links
are few enough for one task's memory by a stated bound, one union-find in that task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): m the least of a and all its b; the minimum is taken before anything is joined."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return edges.join(least, "a")


def _union_find(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, most_rounds: int = 60, local_links: int = 200_000) -> DataFrame:
    """node, root (the least node reachable) of every node that has a link. links: a, b (long), in any direction, loops allowed."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.limit(local_links + 1).count() <= local_links:
        return cut(edges.repartition(1).mapInArrow(_union_find, "node long, root long"))
    before = _signature(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = cut(small)
        now = _signature(edges)
        if now == before:
            roots = edges.select("b").distinct()
            return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root"))))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
