"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the node's smallest neighbour or itself."""
    sides = _both_ways(edges)
    least = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node that has an edge; edges hold longs u, v.

    component is the smallest node reachable. Groups are only aggregated by min
    and joined, so that no node's neighbours gather in one task. Null ends and
    loops are ignored; repeated edges don't matter; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    seen = None
    while True:
        count, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, check) == seen or not count:
            return now.select("u", F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("u"), F.col("v").alias("component"))).groupBy("u").agg(F.min("component").alias("component"))
        seen = (count, check)
        now = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
