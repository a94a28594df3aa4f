"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node reachable.

    Every round is a join-free regrouping of the edge list: neighbours hang on the smallest of
    them, so hot nodes only pass minima around. It ends when an alternation changes nothing.
    """
    now = scratch.save(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low < high").distinct())
    digest = _digest(now)
    while True:
        both = now.union(now.select("high", "low")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("other > node").join(least, "node").select(F.col("m").alias("low"), F.col("other").alias("high")).filter("low < high").distinct()
        # small-star: each node hangs itself and its smaller neighbours on the smallest of them
        small = large.groupBy("high").agg(F.min("low").alias("m"))
        hung = large.join(small, "high").select(F.col("m").alias("low"), F.col("low").alias("high")).filter("low < high").union(small.select("m", "high")).distinct()
        new = scratch.save(hung)
        before, digest = digest, _digest(new)
        scratch.drop(now)
        now = new
        if before == digest:
            return now.select(F.col("high").alias("node"), F.col("low").alias("label")).union(now.select("low", "low").distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(low, high))"), F.expr("try_sum(cast(xxhash64(high, low) as decimal(38,0)))")).first())
