"""Connected components of a graph of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of a link (a, b) can reach. Links to itself and nulls count for nothing."""
    edges = common.saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a hub may have a large share of all links: joined() doesn't bring these together in one task
        least = common.saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = common.saved(common.joined(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        common.dropped(least)
        least = common.saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = common.joined(large, least, ["a"], "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before = edges
        edges = common.saved(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        common.dropped(before, large, least)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
