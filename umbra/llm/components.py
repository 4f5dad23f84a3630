"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import materialize, release


def forest(pairs) -> list[tuple[int, int]]:
    """Star edges (member, smallest member) of the components of a few pairs."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _contract(batches):
    for b in batches:
        found = forest(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs to ``(u, root)``, root the smallest member; nodes that
    are a root themselves have no row. Each round is written to a table, so that a
    lost executor costs one round; the number of rounds follows the logarithm of the
    longest chain. The join with the minima shuffles both sides, so that AQE can
    split a hub with many neighbours."""
    contracted = lambda e: e.mapInArrow(_contract, "u long, v long").distinct()
    now = materialize(contracted(edges.where("u != v")), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        before, now = now, materialize(contracted(small.where("u != v")), "edges")
        release(before, large)
    return now.select("u", F.col("v").alias("root"))


def stars(edges: DataFrame) -> bool:
    """Whether each node has one edge, to the smallest of its component."""
    nodes = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
    return nodes["n"] == nodes["nodes"] and edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
