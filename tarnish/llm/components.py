"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.session import stored


def _are_stars(edges: DataFrame) -> bool:
    """Does every node point at one other at most, and none of those point on?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    met = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not met.agg(F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))), F.lit(False))).first()[0]


def _pointed(edges: DataFrame, lower_only: bool) -> DataFrame:
    """Every node's neighbours point at the smallest of them; a star is one join with one minimum per node."""
    if lower_only:
        near = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    # written before the join, so that the neighbours of a hub can be split
    least = stored(near.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least")), "least")
    met = near.join(least, "node")
    if lower_only:
        moved = met.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        moved = met.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return moved.where("a <> b").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(a, b): each node of a link (a, b) but the smallest of its component, with that smallest.

    Large stars tie a node's greater neighbours to its least one, small stars tie the lesser ones,
    until every component is one star. Each round is written to the shared folder, and one truth
    value reaches the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if _are_stars(edges):
        return edges
    # ties a node's many centres to the least one, after which few links are left
    edges = stored(_pointed(edges, lower_only=True), "links")
    while not _are_stars(edges):
        edges = stored(_pointed(_pointed(edges, lower_only=False), lower_only=True), "links")
    return edges
