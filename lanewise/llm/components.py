"""Connected components of links between numbered nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, hot_join, stage, unstage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large star) or smaller (small star) neighbours and itself move to its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.filter("b < a")
    least = stage(side.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.first("a")).alias("m")), "star")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = hot_join(side, least, "a", "n", total)
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that has a link (a, b)."""
    now = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        with Staged() as own:
            wide = own.keep(stage(_star(now, True), "links"))
        with Staged() as own:
            near = own.keep(stage(_star(wide, False), "links"))
        unstage(now, wide)
        now = near
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
