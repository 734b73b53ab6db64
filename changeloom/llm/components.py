"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.session import durable, shuffles_released


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, u): each node v that isn't the smallest of its component, with the smallest node u.

    ``edges`` has long columns a and b; NULL ends and loops are left out.  Alternating large and small stars, each round cut
    from its lineage, until no node is both a centre and a leaf and none has two centres.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    for _ in range(max_rounds):
        ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
            edges.select(F.col("u").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        state = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        with shuffles_released(edges.sparkSession):
            if state.where("leaf > 1 OR (leaf > 0 AND centre > 0)").isEmpty():
                return edges
        # Large star: each larger neighbour of a node hangs under the smallest node around that node.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(around, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: each node and its smaller neighbours hang under the smallest of them.
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(
            below.select("v", F.col("m").alias("u"))).distinct()
        edges = durable(small.select("v", "u"))
    raise RuntimeError("components did not settle")
