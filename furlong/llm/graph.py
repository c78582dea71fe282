"""Connected components by alternating large-star and small-star steps, in joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches; nodes without edges are absent.

    Each step writes its edges, so a lost executor costs one step. Neighbours are never
    gathered: a node's smallest neighbour is a partial aggregate, and AQE splits a hot node's edges.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    while True:
        # large-star: every larger neighbour is linked to the smallest of the neighbourhood
        back = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.unionByName(back).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = back.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every node is linked, with its smaller neighbours, to the smallest of them; those are few after the large-star
        low = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = low.select(F.explode(F.when(F.col("b") == F.col("m"), F.array(pair("a"))).otherwise(F.array(pair("a"), pair("b")))).alias("e")).select("e.*").distinct()
        after = written(small)
        state = _state(after)
        drop_written(now)
        now = after
        if seen == state:
            break
        seen = state
    # at the fixed point every node but the root has one edge, to the root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
