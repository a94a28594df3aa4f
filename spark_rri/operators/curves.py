"""Curves over score thresholds, their means over parts, and score matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import running, with_previous


def pr_points(scores: DataFrame, part: str, score: str, label: str) -> DataFrame:
    """(part, score, n_pos, precision, recall) of every distinct score as threshold; parts without positives give none.

    Scores are counted before they are ordered.
    """
    at = scores.groupBy(part, score).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("n_pos"))
    total = at.groupBy(F.col(part).alias("__part")).agg(F.sum("n_pos").alias("total"))
    run = running(at, part, [F.desc(score)], {"all": "n", "hits": "n_pos"}).join(total, F.col(part).eqNullSafe(F.col("__part")))
    return run.filter("total > 0").select(part, score, "n_pos", (F.col("hits") / F.col("all")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"), "total")


def average_precision(scores: DataFrame, part: str, score: str, label: str) -> DataFrame:
    """(part, average_precision): precision at each threshold weighted by the recall it adds."""
    return pr_points(scores, part, score, label).groupBy(part).agg(F.sum(F.col("precision") * F.col("n_pos") / F.col("total")).alias("average_precision"))


def pr_auc(scores: DataFrame, part: str, score: str, label: str, least_recall: float = 0.01) -> DataFrame:
    """(part, pr_auc): trapezoids under the points with a recall over ``least_recall``."""
    points = pr_points(scores, part, score, label).filter(F.col("recall") > least_recall)
    points = with_previous(points, part, [F.desc(score)], {"__recall": "recall", "__precision": "precision"})
    slab = (F.col("recall") - F.col("__recall")) * (F.col("precision") + F.col("__precision")) / 2
    return points.withColumn("slab", slab).groupBy(part).agg(F.coalesce(F.sum("slab"), F.lit(0.0)).alias("pr_auc"))


def on_grid(points: DataFrame, part: str, x: str, y: str, steps: int = 100, start: float = 0.0) -> DataFrame:
    """(part, k, value): a rising curve at k / steps, linear between its points and ``start`` at 0.

    Each segment gives the grid places it covers, so no part is joined with the grid; places
    behind a curve's last point are missing.
    """
    ends = with_previous(points.select(part, F.col(x).alias("x1"), F.col(y).alias("y1")), part, [F.col("x1"), F.col("y1")], {"x0": "x1", "y0": "y1"})
    ends = ends.withColumns({"x0": F.coalesce("x0", F.lit(0.0)), "y0": F.coalesce("y0", F.lit(start))})
    place = lambda c: F.floor(F.col(c) * steps + 1e-9).cast("int")
    inner = ends.filter(place("x1") > place("x0")).withColumn("k", F.explode(F.sequence(place("x0") + 1, place("x1"))))
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("k") / steps - F.col("x0")) / (F.col("x1") - F.col("x0"))
    first = points.select(part).distinct().select(part, F.lit(0).alias("k"), F.lit(start).alias("value"))
    return inner.select(part, "k", value.alias("value")).union(first)


def mean_curve(points: DataFrame, part: str, x: str, y: str, steps: int = 100, start: float = 0.0) -> DataFrame:
    """(x, mean, parts) over all parts' curves."""
    grid = on_grid(points, part, x, y, steps, start)
    return grid.groupBy("k").agg(F.avg("value").alias("mean"), F.count("*").alias("parts")).select((F.col("k") / steps).alias("x"), "mean", "parts")


def to_rows(scores: DataFrame, part: str, i: str, j: str, score: str) -> DataFrame:
    """(part, i, row): a score matrix by rows, [j, score] in the order of j; a row is as long as one partner."""
    return scores.groupBy(part, i).agg(F.array_sort(F.collect_list(F.struct(j, score))).alias("row"))


def to_long(rows: DataFrame, part: str, i: str) -> DataFrame:
    return rows.select(part, i, F.inline("row"))


def add_matrix(scores: DataFrame, other: DataFrame, keys: list[str], score: str, added: str, weight: float = 1.0) -> DataFrame:
    """Scores plus the weighted entries of another matrix, whose missing entries count 0."""
    side = other.select(*keys, F.col(added).alias("__added"))
    return scores.join(side, keys, "left").withColumn(score, F.col(score) + weight * F.coalesce("__added", F.lit(0.0))).drop("__added")
