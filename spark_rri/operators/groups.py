"""Connected groups and family relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import with_checkpoints


def connected_groups(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node reachable. Labels spread to neighbours and then jump to their label's label.

    Every round cuts lineage with a checkpoint in the session's checkpoint folder. Labels and edges are merged, never sent to
    all tasks: that passes through the driver in every round, where the tables of several rounds would lie at once.
    """
    with_checkpoints(nodes.sparkSession)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct().checkpoint()
    labels = nodes.select(F.col(node).alias("u"), F.col(node).alias("label")).distinct().checkpoint()
    while True:
        met = both.join(labels.withColumnRenamed("u", "v").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("m"))
        near = labels.join(met.hint("merge"), "u", "left").select("u", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        up = labels.select(F.col("u").alias("m"), F.col("label").alias("up"))
        new = near.join(up.hint("merge"), "m", "left").select("u", "label", F.least("m", F.coalesce("up", "m")).alias("new")).checkpoint()
        moved = new.filter("label != new").limit(1).count()
        labels = new.select("u", F.col("new").alias("label"))
        if not moved:
            return labels.withColumnRenamed("u", node)


def family_hubs(families: DataFrame, key: str) -> DataFrame:
    """(key, one, two): each pair of a left and a right family of a key, in order (columns key, side L or R, family).

    Keys that share such a pair have meeting left and meeting right families, or meet crosswise, and the other way round.
    """
    left = families.filter("side = 'L'").select(key, F.col("family").alias("f"))
    right = families.filter("side = 'R'").select(key, F.col("family").alias("g"))
    return left.join(right, key).select(key, F.least("f", "g").alias("one"), F.greatest("f", "g").alias("two")).distinct()


def related(families: DataFrame, key: str) -> DataFrame:
    """Pairs (a < b) of keys whose families meet on both sides, directly or crosswise. For groups, see ``related_groups``."""
    hubs = family_hubs(families, key)
    pairs = hubs.withColumnRenamed(key, "a").join(hubs.withColumnRenamed(key, "b"), ["one", "two"]).filter("a < b")
    return pairs.select("a", "b").distinct()


def related_groups(families: DataFrame, key: str) -> DataFrame:
    """(key, label) of keys connected by related families; a hub ties its keys to the smallest, so a hot family gives no pairs."""
    hubs = family_hubs(families, key)
    edges = hubs.join(hubs.groupBy("one", "two").agg(F.min(key).alias("__low")).hint("merge"), ["one", "two"]).select(F.col("__low").alias("a"), F.col(key).alias("b")).filter("a < b")
    return connected_groups(families.select(key).distinct(), edges, key, "a", "b")
