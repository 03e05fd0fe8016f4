"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v). Each node's least neighbour comes from an aggregation with map-side
    combining; its neighbours are met by a join, whose large partitions Spark can split, so that
    a node with very many neighbours is never gathered into one task."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    edges: columns u, v of one orderable type; null ends, loops and repeated rows count for nothing.
    Returns node, root for every node of a remaining edge; root is the least node of its component.
    An empty table gives an empty result. Raises if max_rounds steps do not settle it.
    """
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if now["n"] == now["d"] and (not now["n"] or chained.isEmpty()):
            break
        edges = durable(_star(_star(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
