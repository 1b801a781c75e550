"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricledger.llm.common import written


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge has one only, to a node without: the rounds change no such edges. ``edges``: u, v, no row twice."""
    left, right = F.lit(1).alias("left"), F.lit(0).alias("left")
    ends = edges.select(F.col("u").alias("node"), left).unionByName(edges.select(F.col("v").alias("node"), right))
    counts = ends.groupBy("node").agg(F.sum("left").alias("left"), F.min("left").alias("least"))
    return counts.agg(F.count_if(F.expr("left > 1 OR (left = 1 AND least = 0)"))).first()[0] == 0


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours. Rows may repeat."""
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """node, root of every node that is not its component's smallest. ``edges``: u, v with u > v, any order of rows.

    Alternating large and small stars, a logarithmic number of rounds in practice, until the edges are stars; each round is written, so the lineage
    stays short. Both steps join each edge with one row for its node, so a node with very many neighbours is
    a skewed join, which adaptive execution splits, and not a group in one task.
    """
    now = written(edges.where("u <> v").distinct(), "edges")
    while not _settled(now):
        now = written(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
