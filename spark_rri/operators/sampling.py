"""Repeatable sampling and leakage-free splitting."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import stored
from .scans import least_rows, numbered, placed_in_group, running


def draw(*keys: str, salt: str = "") -> Column:
    """A repeatable order of rows, the same in any engine."""
    return F.md5(F.concat_ws("#", *[F.col(k).cast("string") for k in keys], F.lit(salt)))


def negative_sampling(rows: DataFrame, part: str, label: str, keys: list[str], times: float = 3.0, salt: str = "") -> DataFrame:
    """All positives and ``times`` as many negatives of each group, by hash order; groups without positives drop out."""
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    pos = rows.groupBy(part).agg(F.count_if(positive).alias("__p")).filter("__p > 0")
    wanted = pos.select(part, F.floor(F.col("__p") * times).alias("__k"))
    return rows.filter(positive).unionByName(least_rows(rows.filter(~positive), part, wanted, draw(part, *keys, salt=salt), keys))


def capped(rows: DataFrame, part: str, keep: Column, keys: list[str], cap: int, salt: str = "") -> DataFrame:
    """All rows to keep and at most ``cap`` others of each group, by hash order: the cap is the feature."""
    kept = F.coalesce(keep, F.lit(False))
    wanted = rows.select(part).distinct().withColumn("__k", F.lit(cap))
    return rows.filter(kept).unionByName(least_rows(rows.filter(~kept), part, wanted, draw(part, *keys, salt=salt), keys))


def bootstrap(rows: DataFrame, part: str, keys: list[str], share: float = 0.7, salt: str = "") -> DataFrame:
    """share x n draws with replacement of each group, draws numbered.

    A group's rows are numbered in order of the keys; its first rows stand for the draws, so that a large
    group's draws are made in many tasks, and each draw is met by the row that its hash names.
    """
    placed = placed_in_group(rows, [part], [F.col(k) for k in keys], "__row")
    size = placed.groupBy(F.col(part).alias("__part")).agg(F.count("*").alias("__n"))
    wanted = F.greatest(F.floor(F.col("__n") * F.lit(share)), F.lit(1))
    draws = placed.select(F.col(part).alias("__p"), (F.col("__row") + 1).cast("int").alias("draw")).join(size, F.col("__p").eqNullSafe(F.col("__part"))).filter(F.col("draw") <= wanted)
    number = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("__p").cast("string"), F.col("draw").cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
    drawn = draws.select(F.col("__p"), "draw", (number % F.col("__n")).alias("__at"))
    return placed.join(drawn, F.col(part).eqNullSafe(F.col("__p")) & (F.col("__row") == F.col("__at"))).select(part, "draw", *[c for c in rows.columns if c != part])


def one_per_group(rows: DataFrame, part: str, key: str, salt: str = "") -> DataFrame:
    """One member of each group, by hash order."""
    return rows.groupBy(part).agg(F.min_by(key, F.struct(draw(key, salt=salt), key)).alias(key))


def least_loaded(groups: list[tuple], loads: list[int]) -> dict:
    """group -> fold: each of the (group, size) in turn to the fold with the least load, the first of equals; loads are added to."""
    heap, out = sorted((load, k) for k, load in enumerate(loads)), {}
    for group, size in groups:
        load, k = heap[0]
        out[group], loads[k] = k, load + size
        heapq.heapreplace(heap, (load + size, k))
    return out


def level_room(loads: list[int], total: float) -> list[float]:
    """How much of ``total`` every fold takes so that all that take any end level."""
    low = sorted(loads)
    for k in range(len(low), 0, -1):
        level = (sum(low[:k]) + total) / k
        if level >= low[k - 1]:
            return [max(level - x, 0.0) for x in loads]
    return [0.0] * len(loads)


def group_folds(groups: DataFrame, group: str, size: str, folds: int, most: int = 10_000) -> DataFrame:
    """(group, size, fold): groups by falling size each to the least loaded fold; -1 leaves one group out per fold.

    The ``most`` largest groups are dealt one by one on the driver. Of more groups, those between the
    largest and the ``most`` smallest fill the folds up to one level by running sums, in any number of
    tasks, and the smallest are dealt one by one again, which evens out what the sums cut unevenly.
    """
    if folds == -1:
        return numbered(groups, [F.col(group)], "fold")
    spark, kinds = groups.sparkSession, groups.schema
    falling = [F.desc(size), F.asc(group)]
    every = groups.select(group, size).filter(F.col(group).isNotNull())
    loads = [0] * folds
    head = [tuple(r) for r in every.orderBy(*falling).limit(most).collect()]
    dealt = least_loaded(head, loads)
    rest, middle = None, None
    if len(head) == most:
        last_group, last_size = head[-1]
        behind = (F.col(size) < F.lit(last_size)) | (F.col(size) == F.lit(last_size)) & (F.col(group) > F.lit(last_group))
        rest = stored(every.filter(behind))
        tail = [tuple(r) for r in rest.orderBy(F.asc(size), F.desc(group)).limit(most).collect()][::-1]
        if tail:
            first_group, first_size = tail[0]
            before = (F.col(size) > F.lit(first_size)) | (F.col(size) == F.lit(first_size)) & (F.col(group) < F.lit(first_group))
            middle = rest.filter(before).withColumn("__all", F.lit(0))
            room = level_room(loads, middle.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
            ends = [sum(room[: k + 1]) for k in range(folds - 1)]
            placed = running(middle, "__all", falling, {"__upto": size})
            fold = F.size(F.filter(F.lit(ends).cast("array<double>"), lambda e: e <= F.col("__upto") - F.col(size) / 2)) if ends else F.lit(0)
            middle = stored(placed.select(group, size, fold.cast("int").alias("fold")))
            for r in middle.groupBy("fold").agg(F.sum(size)).collect():
                loads[r[0]] += r[1]
            dealt |= least_loaded(tail, loads)
            head += tail
    schema = StructType([kinds[group], kinds[size], StructField("fold", IntegerType())])
    out = spark.createDataFrame([(g, n, dealt[g]) for g, n in head], schema)
    return out if middle is None else out.unionByName(middle)


def sub_folds(folds: DataFrame, group: str, size: str, n_folds: int, parts: int) -> DataFrame:
    """For every outer fold, its training groups dealt to ``parts`` sub-folds by falling size."""
    outer = folds.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("test_fold"))
    train = F.broadcast(outer).join(folds, F.col("fold") != F.col("test_fold"))
    placed = placed_in_group(train.select("test_fold", group, size), ["test_fold"], [F.desc(size), F.col(group)], "__place")
    return placed.select("test_fold", group, (F.col("__place") % parts).cast("int").alias("sub_fold"))


def leakage_free(rows: DataFrame, key: str, lineage: str, tests: DataFrame) -> DataFrame:
    """(row, fold) for every test fold and the rows whose lineage holds none of its ids (columns fold, test_ids).

    Leaks are found by a join on ids and taken out by (key, fold); folds are few.
    """
    folds = [r[0] for r in tests.select("fold").distinct().orderBy("fold").collect()]
    every = rows.withColumn("fold", F.explode(F.lit(folds).cast(f"array<{tests.schema['fold'].dataType.simpleString()}>")))
    leaks = rows.select(key, F.explode(lineage).alias("__id")).join(tests.select("fold", F.explode("test_ids").alias("__id")), "__id")
    return every.join(leaks.select(key, "fold").distinct(), [key, "fold"], "left_anti")


def independent_split(rows: DataFrame, group: str, test_groups: DataFrame, key: str, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, test): one member of every group outside the test groups, and all members of those."""
    test = rows.join(test_groups.select(group).distinct(), group, "left_semi")
    train = rows.join(test_groups.select(group).distinct(), group, "left_anti")
    return one_per_group(train, group, key, salt), test
