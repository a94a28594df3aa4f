"""From pair scores to site scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import placed_in_group


#: Pieces into which a group is dealt before its best rows are sought.
PIECES = 64


def ranked(rows: DataFrame, part: str, score: str, ties: list[str], out: str = "rank") -> DataFrame:
    """Rank by falling score within a group; ties go by the given unique keys.

    Rows are numbered in one order over all groups, by ranges, so a group may fill many tasks.
    """
    placed = placed_in_group(rows, [part], [F.desc(score), *[F.col(t) for t in ties]], "__at")
    return placed.withColumn(out, (F.col("__at") + 1).cast("int")).drop("__at")


def best_first(score: str, ties: list[str]) -> Column:
    """A value that grows in the order of ``ranked``: falling score (NaN first, NULL last), then ties."""
    s = F.col(score).cast("double")
    return F.struct(s.isNull().alias("none"), (~F.isnan(s)).alias("number"), (-s).alias("falling"), *ties)


def top_rows(rows: DataFrame, part: str, score: str, ties: list[str], n: int) -> DataFrame:
    """The n best rows of each group, ranked: the best of its pieces first, so that n x PIECES rows of a group meet at most."""
    order = [F.desc(score), *ties]
    pieces = rows.withColumn("__piece", F.pmod(F.xxhash64(*ties), F.lit(PIECES)))
    some = pieces.withColumn("rank", F.row_number().over(Window.partitionBy(part, "__piece").orderBy(*order))).filter(F.col("rank") <= n).drop("__piece", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order))).filter(F.col("rank") <= n)


def among_best(rows: DataFrame, part: str, score: str, ties: list[str], n: int, out: str) -> DataFrame:
    """Marks the n best rows of each group: those up to its n-th in order."""
    last = top_rows(rows, part, score, ties, n).groupBy(F.col(part).alias("__part")).agg(F.max(best_first(score, ties)).alias("__last"))
    return rows.join(last, F.col(part).eqNullSafe(F.col("__part")), "left").withColumn(out, best_first(score, ties) <= F.col("__last")).drop("__part", "__last")


def top_fraction(rows: DataFrame, part: str, score: str, ties: list[str], fraction: float) -> DataFrame:
    """The best share of each group, rounded down."""
    size = rows.groupBy(F.col(part).alias("__part")).agg(F.count("*").alias("__n"))
    return ranked(rows, part, score, ties).join(size, F.col(part).eqNullSafe(F.col("__part"))).filter(F.col("rank") <= F.floor(F.col("__n") * fraction)).drop("__n", "__part")


def multiscale_vote(pairs: DataFrame, part: str, score: str, ties: list[str], site: str, low: int = 3, high: int = 11) -> DataFrame:
    """Per site, the sum over i of its share of the 2**i best pairs, 2**low to 2**high.

    A pair of rank r adds 2**-i for every i with 2**i >= r, a function of the rank alone.
    """
    best = top_rows(pairs, part, score, ties, 1 << high)
    weight = sum((F.when(F.col("rank") <= 1 << i, F.lit(2.0**-i)).otherwise(0.0) for i in range(low + 1, high + 1)), F.when(F.col("rank") <= 1 << low, F.lit(2.0**-low)).otherwise(0.0))
    return best.groupBy(part, site).agg(F.sum(weight).alias("vote"))


def max_pool(pairs: DataFrame, part: str, site: str, score: str) -> DataFrame:
    return pairs.groupBy(part, site).agg(F.max(score).alias("site_score"), F.count("*").alias("n_pairs"))


def above_threshold(scores: DataFrame, part: str, score: str, threshold: float) -> DataFrame:
    """(group, any_above, n_above): whether any row of each group exceeds the threshold, and how many do; NULL scores do not."""
    above = F.coalesce(F.col(score) > threshold, F.lit(False))
    return scores.groupBy(part).agg(F.bool_or(above).alias("any_above"), F.count_if(above).alias("n_above"))


def symmetric_mean(pairs: DataFrame, part: str, a: str, b: str, score: str) -> DataFrame:
    """Average of (a, b) and (b, a), on both; pairs with a NULL key drop out.

    Only the scores of a pair meet in a window, so rows that lie by ``part`` need not move.
    """
    known = pairs.filter(F.col(part).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.withColumn("symmetric", F.avg(score).over(Window.partitionBy(part, F.least(a, b), F.greatest(a, b))))


def orientation_mean(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean over orientations and sub-models of each pair."""
    return scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_scores"))


def transposed(frame: DataFrame, ids: list[str], left: list[str], right: list[str], keep: list[str]) -> DataFrame:
    """Both orientations: the second with the left and right blocks swapped. Rows stay where they are."""
    way = lambda name, l, r: F.struct(F.lit(name).alias("orientation"), *[F.col(c).alias(o) for c, o in zip([*l, *r], [*left, *right], strict=True)])
    out = frame.select(*ids, *keep, F.inline(F.array(way("d", left, right), way("t", right, left))))
    return out.select("orientation", *ids, *left, *right, *keep)


def confusion_class(pairs: DataFrame, part: str, score: str, ties: list[str], label: str, n: int) -> DataFrame:
    """0 true negative, 1 false negative, 2 false positive, 3 true positive, the best n being positive calls."""
    marked = among_best(pairs, part, score, ties, n, "__best")
    return marked.withColumn("confusion", 2 * F.col("__best").cast("int") + (F.col(label) == 1).cast("int")).drop("__best")
