"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u (or u itself) as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _done(stars: DataFrame) -> bool:
    """Whether every node points to one node that points nowhere."""
    of = stars.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    on = of.join(of.select(F.col("u").alias("v"), F.lit(True).alias("__on")), "v", "left")
    return on.where("n > 1 or __on").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the least node that it reaches.

    Every round hooks all neighbours of a node to its least neighbour, first the larger ones,
    then the smaller ones; distances shrink geometrically. Rounds are written to the shared
    folder and end when only stars are left.
    """
    # Stars point from a larger to a smaller node.
    now = C.materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while not _done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        near = _nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, C.materialise(small, "stars")
        C.discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
