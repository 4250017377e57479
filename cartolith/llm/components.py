"""Connected components of an edge table by alternating star contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for all nodes of the edges (a, b) but the least of each component, which is its label.

    Stars are contracted until the edges no longer change; each round is written, so lost executors cost one round.
    """
    current = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = _signature(current)
    while before[0]:
        following = scratch.write(_small_star(_large_star(current)), "star")
        after = _signature(following)
        scratch.drop(current)
        current = following
        if after == before:
            break
        before = after
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._cartolith_path = current._cartolith_path
    return out
