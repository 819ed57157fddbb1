"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_step, materialize


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v; both are an aggregate and a join on the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return materialize(small.filter("u > v").distinct(), name)


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down and none that leads on from there: every component is a star around its least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("end")).filter("downs > 1 OR (downs = 1 AND end = 0)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node that it can reach.

    Loops, repeated and reversed edges don't matter; an empty table gives an empty one. Every step is written to the
    shared folder, so that lineage stays short; nothing but one answer a step comes to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    while True:
        used, now = now, _stars(now, name)
        drop_step(used)
        if _only_stars(now):
            break
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), name)
    drop_step(now)
    return out
