"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a few joins and aggregations of the edges; nothing is gathered on the driver but a count
and a checksum. Lineage is cut after each round in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _is_final(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    rows, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return rows == nodes and edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that isn't the smallest of its component, with the smallest. Edges have u > v, both long."""
    edges = cut(edges.select("u", "v").distinct())
    while not _is_final(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components of ``labels`` (as ``components`` gives them) after more edges: only the graph of
    components that the new edges connect is solved."""
    if labels is None:
        return components(edges)
    top = labels.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    up = edges.join(top, F.col("u") == F.col("_u"), "left").select(F.coalesce("_v", "u").alias("u"), "v")
    both = up.join(top, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v")).where(F.col("u") != F.col("v"))
    news = components(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = labels.join(news.select(F.col("u").alias("v"), F.col("v").alias("_v")), "v", "left").select("u", F.coalesce("_v", "v").alias("v"))
    return cut(moved.unionByName(news))
