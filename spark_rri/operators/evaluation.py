"""Evaluation operators: exact, grouped, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import running
from .scoring import best_first, top_rows


def roc_auc(scores: DataFrame, part: str, score: str, label: str, missing: float | None = 0.5) -> DataFrame:
    """Rank-sum area with mid-ranks for ties; ``missing`` where a class is absent.

    Rows are first counted by distinct score, so ranks run over score values instead of rows.
    """
    by = scores.groupBy(part, score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    mid = running(by, part, [F.col(score)], {"below": "n"}).withColumn("mid", F.col("below") - (F.col("n") - 1) / 2)
    s = mid.groupBy(part).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    auc = F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).otherwise(F.lit(missing))
    return s.select(part, F.col("p").alias("n_pos"), neg.alias("n_neg"), auc.alias("auc"))


def precision_recall_at(scores: DataFrame, part: str, score: str, ties: list[str], label: str, ks: list[int]) -> DataFrame:
    """Precision and recall of the k best of each group; k is at most the group's rows."""
    hit = F.col(label) == 1
    sizes = scores.groupBy(part).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_pos"))
    found = top_rows(scores, part, score, ties, max(ks)).groupBy(F.col(part).alias("__part")).agg(*[F.count_if(hit & (F.col("rank") <= k)).alias(f"__{k}") for k in ks])
    out = sizes.join(found, F.col(part).eqNullSafe(F.col("__part")))
    rates = [c for k in ks for c in ((F.col(f"__{k}") / F.least(F.lit(k), F.col("n"))).alias(f"prec_{k}"), (F.col(f"__{k}") / F.nullif(F.col("n_pos"), F.lit(0))).alias(f"reca_{k}"))]
    return out.select(part, "n", "n_pos", *rates)


def threshold_sweep(scores: DataFrame, part: str, score: str, label: str, digits: int = 4) -> DataFrame:
    """Confusion counts and metrics for every distinct rounded score but the first and last.

    A row is called positive when its raw score exceeds the rounded threshold. Rows are counted
    by rounded score with the tails inside the bucket; cumulative sums do the rest in one pass.
    """
    t = scores.withColumn("t", F.round(score, digits)).withColumn("y", (F.col(label) == 1).cast("long"))
    b = t.groupBy(part, "t").agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.count_if(F.col(score) > F.col("t")).alias("n_in"), F.count_if((F.col(score) > F.col("t")) & (F.col("y") == 1)).alias("p_in"))
    b = running(b, part, [F.desc("t")], {"run_n": "n", "run_p": "p"})
    sizes = b.groupBy(F.col(part).alias("__part")).agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"), F.min("t").alias("first"), F.max("t").alias("last"))
    b = b.join(sizes, F.col(part).eqNullSafe(F.col("__part"))).filter("t > first and t < last")
    b = b.withColumns({"called": F.col("run_n") - F.col("n") + F.col("n_in"), "tp": F.col("run_p") - F.col("p") + F.col("p_in")})
    return metrics(b.select(part, "t", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("all_p") - F.col("called") + F.col("tp")).alias("tn")))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, specificity and Matthews correlation to tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.withColumns({
        "prec": tp / F.nullif(tp + fp, zero),
        "reca": tp / F.nullif(tp + fn, zero),
        "spec": tn / F.nullif(tn + fp, zero),
        "mcc": F.coalesce((tp * tn - fp * fn) / F.nullif(F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn), zero), zero),
    })


def at_threshold(scores: DataFrame, part: str, score: str, label: str, threshold: float) -> DataFrame:
    """Confusion counts and metrics of each group at one threshold."""
    call, y = F.col(score) > threshold, F.col(label) == 1
    return metrics(scores.groupBy(part).agg(F.count_if(call & y).alias("tp"), F.count_if(call & ~y).alias("fp"), F.count_if(~call & y).alias("fn"), F.count_if(~call & ~y).alias("tn")))


def best_threshold(sweep: DataFrame, part: str, distance: Column) -> DataFrame:
    """The sweep's row of least distance; the lowest threshold of equals."""
    return sweep.withColumn("gap", distance).groupBy(part).agg(F.min_by(F.struct("t", "prec", "reca", "mcc"), F.struct("gap", "t")).alias("b")).select(part, "b.*")


def roc_points(scores: DataFrame, part: str, score: str, label: str) -> DataFrame:
    """Cumulative true and false positive rates by falling distinct score."""
    b = scores.groupBy(part, score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    out = running(b.withColumn("f", F.col("n") - F.col("p")), part, [F.desc(score)], {"tp": "p", "fp": "f"})
    sizes = b.groupBy(F.col(part).alias("__part")).agg(F.sum("p").alias("all_p"), F.sum(F.col("n") - F.col("p")).alias("all_n"))
    return out.join(sizes, F.col(part).eqNullSafe(F.col("__part"))).select(part, score, (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif("all_n", F.lit(0))).alias("fpr"))


def first_hits(pairs: DataFrame, part: str, score: str, ties: list[str], label: str) -> DataFrame:
    """Rank of each group's first positive, counted from the rows before it; NULL without one."""
    place = best_first(score, ties)
    best = pairs.groupBy(F.col(part).alias("__part")).agg(F.min(F.when(F.col(label) == 1, place)).alias("__best"))
    ahead = pairs.join(best, F.col(part).eqNullSafe(F.col("__part"))).groupBy(part)
    return ahead.agg(F.when(F.max("__best").isNotNull(), F.count_if(place <= F.col("__best"))).alias("first_rank"))


def hit_rate_curve(first: DataFrame, top: int = 1024) -> DataFrame:
    """For n = 1, 2, 4, .. top: share of groups with a positive among the best n."""
    total = first.agg(F.count("*").alias("groups"))
    at = first.sparkSession.range(top.bit_length()).select(F.expr("cast(shiftleft(1, cast(id as int)) as long)").alias("n"))
    steps = first.groupBy("first_rank").agg(F.count("*").alias("k")).filter("first_rank is not null")
    hits = F.broadcast(at).join(steps, F.col("first_rank") <= F.col("n"), "left").groupBy("n").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("hits"))
    return hits.join(F.broadcast(total)).select("n", "hits", (F.col("hits") / F.col("groups")).alias("hit_rate"))


def with_mean_row(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The rows and one more, ``mean``, of column means."""
    return rows.select(key, *values).unionByName(rows.agg(*[F.avg(v).alias(v) for v in values]).withColumn(key, F.lit("mean")))


def log_fit(points: DataFrame, part: str, t: str, p: str) -> DataFrame:
    """Slope and intercept of p = a ln t + b."""
    x = F.log(F.col(t))
    good = points.filter((F.col(t) > 0) & F.col(p).isNotNull())
    return good.groupBy(part).agg(F.regr_slope(F.col(p), x).alias("slope"), F.regr_intercept(F.col(p), x).alias("intercept"))


def aligned(sites: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Scores on the full list of sites, 0 where missing."""
    return sites.join(scores, keys, "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def expected_interface_size(n: Column) -> Column:
    """Sites expected in an interface of a chain of n."""
    return F.round(6.1 * F.pow(n, 0.3))


def more_metrics(counts: DataFrame) -> DataFrame:
    """Adds accuracy, false positive rate and negative predictive value to tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.withColumns({"accuracy": (tp + tn) / F.nullif(tp + fp + fn + tn, zero), "fpr": fp / F.nullif(fp + tn, zero), "npv": tn / F.nullif(tn + fn, zero)})


def best_correlation(sweep: DataFrame, part: str) -> DataFrame:
    """The sweep's row of highest Matthews correlation, to 12 digits, with all metrics; the lowest threshold of equals."""
    full = more_metrics(sweep)
    names = [c for c in full.columns if c != part]
    return full.groupBy(part).agg(F.min_by(F.struct(*names), F.struct(-F.round("mcc", 12), F.col("t"))).alias("b")).select(part, "b.*")


def report_at(scores: DataFrame, part: str, score: str, label: str, threshold: float = 2.39698) -> DataFrame:
    """Area, counts and metrics of each group at the threshold, and of all rows pooled (group NULL)."""
    pooled = scores.withColumn(part, F.lit(None).cast(scores.schema[part].dataType))

    def told(rows: DataFrame) -> DataFrame:
        area = roc_auc(rows, part, score, label).withColumnRenamed(part, "__part")
        return at_threshold(rows, part, score, label, threshold).join(area, F.col(part).eqNullSafe(F.col("__part"))).drop("__part")

    return told(scores.filter(F.col(part).isNotNull())).unionByName(told(pooled))


def hit_rate_marks(first: DataFrame, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), top: int = 1024) -> DataFrame:
    """(share, n, hit_rate): for every share the n up to ``top`` whose hit rate is nearest to it, the least of equals.

    The rate only changes at a first rank that occurs, so these and 1 are all places to look at.
    """
    total = first.agg(F.count("*").alias("groups"))
    steps = first.filter(F.col("first_rank") <= top).groupBy(F.col("first_rank").cast("long").alias("n")).agg(F.count("*").alias("k"))
    steps = steps.unionByName(first.sparkSession.range(1, 2).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("k"))).groupBy("n").agg(F.sum("k").alias("k"))
    curve = steps.withColumn("hits", F.sum("k").over(Window.orderBy("n"))).join(F.broadcast(total))  # at most ``top`` rows
    rated = curve.select("n", (F.col("hits") / F.col("groups")).alias("hit_rate"), F.explode(F.lit(list(shares))).alias("share"))
    gap = F.round(F.abs(F.col("hit_rate") - F.col("share")), 12)
    return rated.groupBy("share").agg(F.min_by(F.struct("n", "hit_rate"), F.struct(gap, F.col("n"))).alias("b")).select("share", "b.*")


def precision_over_contacts(pairs: DataFrame, part: str, score: str, ties: list[str], label: str, at: int = 500) -> DataFrame:
    """(group, n, contacts, precision, over_contacts): precision among the ``at`` best rows of each group, and its quotient by the group's positives.

    n is ``at``, or the rows of the smallest group if that has fewer, for all groups alike; without positives the quotient is NULL.
    """
    sizes = pairs.groupBy(F.col(part).alias("__part")).agg(F.count("*").alias("__n"), F.count_if(F.col(label) == 1).alias("contacts"))
    n = F.broadcast(sizes.agg(F.least(F.lit(at), F.min("__n")).cast("long").alias("n")))  # one row
    best = top_rows(pairs, part, score, ties, at).join(n).filter(F.col("rank") <= F.col("n"))
    hits = best.groupBy(part, "n").agg(F.count_if(F.col(label) == 1).alias("__hits"))
    met = hits.join(sizes, F.col(part).eqNullSafe(F.col("__part")))
    precision = F.col("__hits") / F.col("n")
    return met.select(part, "n", "contacts", precision.alias("precision"), (precision / F.nullif("contacts", F.lit(0))).alias("over_contacts"))


def mean_hits(pairs: DataFrame, part: str, score: str, ties: list[str], label: str, top: int = 1024) -> DataFrame:
    """(n, mean_hits): positives among the n best rows of a group, averaged over groups, for n = 1, 2, 4, .. top."""
    best = top_rows(pairs, part, score, ties, top)
    groups = pairs.agg(F.count_distinct(part).alias("groups"))
    sizes = [1 << k for k in range(top.bit_length())]
    at = best.filter(F.col(label) == 1).select("rank", F.explode(F.lit(sizes)).alias("n")).filter(F.col("rank") <= F.col("n")).groupBy("n").agg(F.count("*").alias("hits"))
    every = pairs.sparkSession.range(1).select(F.explode(F.lit(sizes)).alias("n"))
    return every.join(at, "n", "left").join(F.broadcast(groups)).select("n", (F.coalesce("hits", F.lit(0)) / F.col("groups")).alias("mean_hits"))
