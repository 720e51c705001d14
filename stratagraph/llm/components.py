"""Connected components of an edge table by alternating large-star and small-star steps. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) links between nodes -> (node, component): every node of a link, and the least node it reaches."""
    step = written(edges.where("u <> v").select("u", "v").distinct(), name)
    state = None
    while True:
        before, step = step, written(_small_star(_large_star(step).distinct()).distinct(), name)
        dropped(before)
        now = step.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
