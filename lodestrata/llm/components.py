"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import FEW, release, store


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge with the smallest node reachable from it.

    edges: columns u and v (long), undirected; self loops and repeats are
    allowed.  Returns node and root.  Each round joins every edge with the
    smallest neighbour of its lower end and then of its upper end, until each
    component is a star around its smallest node.  The number of edges never
    grows, and each round is written to the shared folder, so nothing is
    collected and a lost executor costs one round.  Joins meet a hot node only
    against one row for that node, which adaptive execution can split.  Edges
    that are few enough for one task take their rounds there, without a shuffle.
    """
    stored = now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(now)
    while before[0]:
        if before[0] <= FEW:
            now = now.coalesce(1)
        lower = now.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")
        big = now.join(lower, now.v == lower.node, "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")
        pairs = big.join(least, big.u == least.node).select("u", "v", "low")
        small = pairs.select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = store(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        release(stored)
        stored = now = after
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())
