"""Numbers, running sums and least rows of groups of any size, without a group in one task.

Rows are dealt by ranges of (group, order) and written once; each range is worked on by
itself, and what earlier ranges of a group hold is carried over as one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Hex digits of a hash that one pass of ``least_rows`` tells apart: 4096 bins a group.
BIN = 3


def ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``__range``, ascending in the order, and ``__place`` in it; written, so that both stay."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return stored(dealt).select(*rows.columns, F.expr("shiftright(__id, 33)").alias("__range"), F.expr(f"__id & {(1 << 33) - 1}").alias("__place"))


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 0 in a global order: by their place in a range, shifted by the sizes of the ranges before."""
    dealt = ranges(rows, order)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row per range
    return dealt.join(F.broadcast(before), "__range").withColumn(out, F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def placed_in_group(rows: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Rows numbered from 0 within each group; NULL groups are groups."""
    at = numbered(rows, [*[F.col(g) for g in group], *order], "__global")
    names = [f"__group{k}" for k in range(len(group))]
    first = at.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)]).agg(F.min("__global").alias("__from"))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)]
    return at.join(first, same).withColumn(out, F.col("__global") - F.col("__from")).drop("__global", "__from", *names)


def running(rows: DataFrame, group: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for every ``out: column``, the column's sum over the group's rows up to each row, itself included.

    Only groups that reach over several ranges have anything carried, two rows per range at most. NULL
    groups are groups; rows equal in the order are summed one after the other.
    """
    dealt = ranges(rows, [F.col(group), *order])
    own = Window.partitionBy("__range", group).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy(F.col(group).alias("__group"), "__range").agg(*[F.sum(c).alias(f"__sum_{out}") for out, c in sums.items()])
    at = F.struct("__place", F.col(group).alias("g"))
    edges = dealt.groupBy("__range").agg(F.min(at)["g"].alias("__low"), F.max(at)["g"].alias("__high"))
    # a range's inner groups lie in it alone: only its first and last group can go on elsewhere
    ends = parts.join(F.broadcast(edges), "__range").filter(F.col("__group").eqNullSafe(F.col("__low")) | F.col("__group").eqNullSafe(F.col("__high")))
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__group", F.col("__range").alias("__in"), *[F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0)).alias(f"__before_{out}") for out in sums])
    met = dealt.withColumns({out: F.sum(c).over(own) for out, c in sums.items()}).join(F.broadcast(carried), (F.col("__range") == F.col("__in")) & F.col(group).eqNullSafe(F.col("__group")), "left")
    return met.select(*rows.columns, *[(F.col(out) + F.coalesce(f"__before_{out}", F.lit(0))).alias(out) for out in sums])


def least_rows(rows: DataFrame, group: str, wanted: DataFrame, hash_: Column, ties: list[str]) -> DataFrame:
    """The rows of each group with the least hashes (hex text), as many as ``wanted`` (columns group, __k) says; ties by the given unique keys.

    Two passes count hashes by their leading digits and find the bin that holds the last wanted
    row; only that bin's rows, one in some 16 million of a group, are put in order.
    """
    left = rows.withColumn("__hash", hash_).join(wanted.withColumnRenamed(group, "__wanted"), F.col(group).eqNullSafe(F.col("__wanted"))).drop("__wanted")
    inside = []
    for turn in range(2):
        left = left.withColumn("__bin", F.substring("__hash", 1 + turn * BIN, BIN))
        bins = left.groupBy(F.col(group).alias("__group"), "__bin").agg(F.count("*").alias("__n"), F.first("__k").alias("__k"))  # 16 ** BIN a group at most
        upto = F.sum("__n").over(Window.partitionBy("__group").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
        cut = bins.withColumn("__upto", upto).filter("__upto >= __k and __upto - __n < __k").select("__group", F.col("__bin").alias("__cut"), (F.col("__k") - F.col("__upto") + F.col("__n")).alias("__rest"))
        told = left.join(cut, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
        inside.append(told.filter("__k > 0 and (__cut is null or __bin < __cut)").select(*rows.columns))
        left = told.filter("__bin = __cut").withColumn("__k", F.col("__rest")).drop("__cut", "__rest", "__bin")
    place = F.row_number().over(Window.partitionBy(group).orderBy("__hash", *ties))
    last = left.withColumn("__place", place).filter("__place <= __k").select(*rows.columns)
    return inside[0].unionByName(inside[1]).unionByName(last)


def with_previous(rows: DataFrame, group: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Adds, for every ``out: column``, the column's value in the group's row before; NULL in its first row."""
    placed = stored(placed_in_group(rows, [group], order, "__row"))
    before = placed.select(F.col(group).alias("__group"), (F.col("__row") + 1).alias("__next"), *[F.col(c).alias(out) for out, c in values.items()])
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__row") == F.col("__next"))
    return placed.join(before, same, "left").drop("__row", "__group", "__next")
