"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, store


def open_nodes(links: DataFrame) -> DataFrame:
    """Nodes that keep links u > v from being stars around the least node: with several v, or with a v and a u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node) for every node of an edge; links stay distributed.

    A node with very many neighbours is salted, and every round is written to the
    shared folder.
    """
    links = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    least = {"m": (F.min("v"), F.min)}
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (grouped(both, ["u"], ["v"], least).filter("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct())
        large = store(large, "large-star")
        small = grouped(large, ["u"], ["v"], least)  # v < u here
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        links = store(small, "small-star")
        if not open_nodes(links).limit(1).count():
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
