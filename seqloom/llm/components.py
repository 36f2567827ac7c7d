"""Connected components of an edge list, by alternating large and small stars.

Each round is two shuffled aggregations of narrow rows; the number of rounds grows with the
logarithm of the longest chain. No component meets in one task: a node's neighbours are reduced to
their minimum before they are shuffled, and the join back is one that adaptive execution splits.
(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join deals both sides itself and a hot node's edges can be split
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, component): the least node reachable, for nodes but the least."""
    spark = edges.sparkSession
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(now)
    while before[0]:
        now = settled(spark, "edges", lambda now=now: _small_star(_large_star(now)))
        after = _print(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
