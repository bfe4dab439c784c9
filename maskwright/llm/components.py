"""Distributed connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (long, not null). Returns node, component (the smallest node that links reach), one row for each node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"), in
    O(log^2 n) rounds in practice. Each step takes a minimum for each node, which Spark combines before the shuffle, and a
    join that AQE can split where a node has very many links; no task gathers a node's neighbours. Each round is
    written to the shared folder, so lost executors cost one round at most."""
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    edges = links
    for _ in range(rounds):
        large = _star(edges, larger_only=True)
        small = stored(_star(large, larger_only=False), "edges")
        if edges is not links:
            removed(edges)
        edges = small
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge goes from a node to its component's smallest.
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Every u has one edge, and no v is a u: each v is then the smallest of its component, and its edges reach all of it."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("low")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 OR n = 1 AND low = 1").isEmpty()


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """edges: u > v. Large star: links each larger neighbour of a node to the smallest of the node and its neighbours.
    Small star: links the node and its smaller neighbours to the smallest of them."""
    if larger_only:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An edge (u, v), u > v: u is a larger neighbour of v.
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
