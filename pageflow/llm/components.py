"""Connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop_written, written


def _least(pairs: DataFrame) -> DataFrame:
    """u, the smallest of u and its neighbours, and how many neighbours there are: combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("_v"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "_v").alias("m"), "size")


def _linked(pairs: DataFrame, total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs with the least of their u, and the leasts. A centre with more than ``HOT_SHARE`` of all pairs is hot: its
    pairs stay where they are and meet it by broadcast, so no task gets more than that share."""
    least = written(_least(pairs), f"{name}-least")
    limit = total * HOT_SHARE
    hot = F.broadcast(least.where(F.col("size") > limit).select("u", "m"))
    cold = least.where(F.col("size") <= limit).select("u", "m")
    rest = pairs.join(hot.select("u"), "u", "left_anti").join(cold, "u")
    return pairs.join(hot, "u").unionByName(rest), least


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """u, root for every node of ``edges`` (u, v: long) but the roots themselves; the root is the smallest node of its
    component. Every step is written, so its lineage is short. Links are never gathered outside the executors."""
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(oriented, name)
    n, state = now.count(), None
    while True:
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked, large_least = _linked(both, 2 * n, name)
        large = written(linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        # Small star: u, whose neighbours are all smaller, and they go to the least of them.
        linked, small_least = _linked(large, large.count(), name)
        nxt = written(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), name)
        for done in (now, large, large_least, small_least):
            drop_written(done)
        now = nxt
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return now.select("u", F.col("v").alias("root"))
        n, state = row[0], tuple(row)
