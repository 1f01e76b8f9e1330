"""Connected components of an edge list, by alternating large and small stars with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens import runtime


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a smaller one in its component; ``root`` is the smallest.

    The edges end as stars around their roots. Minima are taken before the shuffle, so a hub costs one row per task;
    the joins carry one row per node on one side, which adaptive execution splits at a hub.
    """
    e = runtime.materialise(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("low", "a").alias("low"))
        large = (both.filter("b > a").join(low, F.col("a") == F.col("of"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
        near = large.join(least, F.col("a") == F.col("of"))
        small = (near.select(F.when(F.col("b") > F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"),
                             F.col("low").alias("b")).union(least.select("of", "low")).distinct())
        e = runtime.materialise(small)
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
