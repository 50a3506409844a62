"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node is larger than two others, or larger than one and smaller than another, by edges (a < b): else all are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("larger")).union(edges.select("b", F.lit(1)))
    tall = ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.min("larger").alias("least")).where((F.col("larger") > 1) | ((F.col("larger") == 1) & (F.col("least") == 0)))
    return bool(tall.take(1))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Both star steps take a minimum per node (combined map-side) and join it back, so a node
    with very many edges is never gathered. Edges shrink to stars in logarithmic rounds; the
    loop ends when all are stars around their smallest node.
    """
    current = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while _unfinished(current):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("hub"), F.col("a").alias("leaf"))
        low = down.groupBy("hub").agg(F.min("leaf").alias("low"))
        joined = down.join(low, "hub")
        small = joined.select(F.col("low").alias("a"), F.col("leaf").alias("b")).union(joined.select(F.col("low").alias("a"), F.col("hub").alias("b")))
        current = cut_lineage(small.where("a < b").distinct())
    roots = current.groupBy(F.col("b").alias("_n")).agg(F.min("a").alias("component"))
    return nodes.join(roots, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("component", "node").alias("component"))
