"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the smallest node it sees.

    The smallest neighbour comes from a partial aggregation and a join, so no node's neighbours are
    gathered; a node with very many links is split by the adaptive join.
    """
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = around.join(least, F.col("u") == F.col("n"))
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    tips = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("r")).distinct()
    return tips.join(roots, F.col("u") == F.col("r"), "left").where("n > 1 or r is not null").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (u, v): root is the smallest node of its component."""
    edges = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        edges = durable(_star(_star(edges, True), False))
    tips = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return tips.unionByName(roots)
