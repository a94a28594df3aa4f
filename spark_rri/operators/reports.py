"""Summaries over complexes: metrics at cuts, two models side by side, scores computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import expected_interface_size, first_hits, metrics, roc_auc
from .scoring import ranked


def site_metrics(sites: DataFrame, part: str, score: str, ties: list[str], label: str) -> DataFrame:
    """Confusion counts and metrics of each group's best sites, as many as an interface of its size has."""
    n = sites.groupBy(F.col(part).alias("__part")).agg(F.count("*").alias("__n"))
    called = F.col("rank") <= expected_interface_size(F.col("__n"))
    y = F.col(label) == 1
    counts = [F.count_if(c).alias(k) for k, c in (("tp", called & y), ("fp", called & ~y), ("fn", ~called & y), ("tn", ~called & ~y))]
    return metrics(ranked(sites, part, score, ties).join(n, F.col(part).eqNullSafe(F.col("__part"))).groupBy(part).agg(F.count_if(called).alias("n_called"), *counts))


def nearest_cut(scores: DataFrame, part: str, score: str, label: str, cut: float) -> DataFrame:
    """Metrics of each group, calling positive what reaches its score nearest to the cut, and of all pooled (group NULL) at the cut itself.

    Of equally near scores the lower one counts.
    """
    near = scores.groupBy(F.col(part).alias("__part")).agg(F.min_by(score, F.struct(F.abs(F.col(score) - cut), score)).alias("threshold"))
    y = F.col(label) == 1

    def counts(call):
        return [F.count_if(c).alias(k) for k, c in (("tp", call & y), ("fp", call & ~y), ("fn", ~call & y), ("tn", ~call & ~y))]

    own = scores.join(near, F.col(part).eqNullSafe(F.col("__part"))).groupBy(part, "threshold").agg(*counts(F.col(score) >= F.col("threshold")))
    pooled = scores.agg(*counts(F.col(score) >= cut)).select(F.lit(None).cast(scores.schema[part].dataType).alias(part), F.lit(cut).alias("threshold"), "tp", "fp", "fn", "tn")
    return metrics(own.unionByName(pooled))


def side_by_side(one: DataFrame, two: DataFrame, part: str, score: str, ties: list[str], label: str) -> DataFrame:
    """Area and rank of the first positive of each group under two models, and which model ranks it earlier."""

    def told(rows: DataFrame, tag: str) -> DataFrame:
        auc = roc_auc(rows, part, score, label).select(part, F.col("auc").alias(f"auc_{tag}"))
        first = first_hits(rows, part, score, ties, label).select(F.col(part).alias("__part"), F.col("first_rank").alias(f"first_{tag}"))
        return auc.join(first, F.col(part).eqNullSafe(F.col("__part"))).drop("__part")

    other = told(two, "b").withColumnRenamed(part, "__part")
    both = told(one, "a").join(other, F.col(part).eqNullSafe(F.col("__part"))).drop("__part")
    better = F.when(F.col("first_a") < F.col("first_b"), "a").when(F.col("first_b") < F.col("first_a"), "b").when(F.col("first_a").isNotNull(), "same")
    return both.withColumn("earlier", better)


def rescored(pairs: DataFrame, part: str, score: str, ties: list[str], site: str, label: str) -> DataFrame:
    """From a saved pair table: site scores by the multi-scale vote, and the area under them by group.

    A site is positive if any of its pairs is; sites without a vote score 0.
    """
    from .scoring import multiscale_vote

    sites = pairs.groupBy(part, site).agg(F.max(label).alias(label))
    vote = multiscale_vote(pairs, part, score, ties, site)
    vote = vote.select(F.col(part).alias("__part"), F.col(site).alias("__site"), "vote")
    met = sites.join(vote, F.col(part).eqNullSafe(F.col("__part")) & F.col(site).eqNullSafe(F.col("__site")), "left").drop("__part", "__site")
    return roc_auc(met.withColumn("vote", F.coalesce("vote", F.lit(0.0))), part, "vote", label)
