"""Other labels for result rows, checks of labelled tables, and variants of complexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import within_partner_contacts
from .sampling import draw
from .scans import least_rows


def relabelled(rows: DataFrame, truth: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The rows that another contact map holds, with its labels."""
    return rows.drop(label).join(truth.select(*keys, label), keys)


def enriched(rows: DataFrame, extra: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Label 1 where a list of more contacts says so; other labels stay."""
    side = extra.select(*keys, F.lit(1).alias("__extra")).distinct()
    return rows.join(side, keys, "left").withColumn(label, F.coalesce("__extra", label)).drop("__extra")


def without_rarest(rows: DataFrame, part: list[str], entity: str) -> DataFrame:
    """Drops the entities of a group whose number of rows is the rarest there, if the numbers differ.

    Of equally rare numbers the smallest counts.
    """
    n = rows.groupBy(*part, entity).agg(F.count("*").alias("__n"))
    kinds = n.groupBy(*part, "__n").agg(F.count("*").alias("__times"))
    rare = kinds.groupBy(*part).agg(F.min_by("__n", F.struct("__times", "__n")).alias("__rare"), F.count("*").alias("__kinds")).filter("__kinds > 1")
    odd = n.join(rare, part).filter("__n = __rare").select(*part, entity)
    return rows.join(odd, [*part, entity], "left_anti")


def positive_share(rows: DataFrame, part: list[str], label: str, difficult: Column) -> DataFrame:
    """By group: rows, positives and their share, and how many rows are difficult."""
    return rows.groupBy(*part).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.avg((F.col(label) == 1).cast("int")).alias("share"), F.count_if(difficult).alias("n_difficult"))


def incomplete(variants: DataFrame, key: str, variant: str, expected: DataFrame) -> DataFrame:
    """(key, n_variants, reason) of complexes that are missing, not expected, or have another number of variants than most.

    The usual number is the most frequent one, of equals the largest.
    """
    n = variants.groupBy(key).agg(F.count_distinct(variant).alias("n_variants"))
    usual = n.groupBy("n_variants").agg(F.count("*").alias("__times")).agg(F.max_by("n_variants", F.struct("__times", "n_variants")).alias("__usual"))
    both = n.join(expected.select(key, F.lit(1).alias("__wanted")).distinct(), key, "full").join(F.broadcast(usual))
    reason = F.when(F.col("n_variants").isNull(), "missing").when(F.col("__wanted").isNull(), "not expected").when(F.col("n_variants") != F.col("__usual"), "other number")
    return both.select(key, F.coalesce("n_variants", F.lit(0)).alias("n_variants"), reason.alias("reason")).filter("reason is not null")


def homo_copy(rows: DataFrame, partner: str, names: dict[str, str], one: str = "l", two: str = "r") -> DataFrame:
    """Both partners of a homo-complex of which one is given: the other is its copy with chains renamed by ``names`` columns {column: column of the new value}."""
    copy = rows.withColumn(partner, F.lit(two)).withColumns({c: F.col(new) for c, new in names.items()})
    gone = list(names.values())
    return rows.withColumn(partner, F.lit(one)).drop(*gone).unionByName(copy.drop(*gone))


def ids_of_any(tables: list[DataFrame], key: str) -> DataFrame:
    """The ids that any of several result tables holds, each once."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def sites_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct residues of one partner of pair rows."""
    return pairs.select(*keys).distinct()


def variant_group(key: Column) -> Column:
    """Complexes that differ only in which side stands for a sequence (x#sl, x#sr) are one group."""
    return F.regexp_replace(key, "#s[lr]$", "")


def of_side(rows: DataFrame, key: str, side: str) -> DataFrame:
    """Of mixed variants (x#sl, x#sr), those whose ``side`` (l or r) is the sequence."""
    return rows.filter(F.regexp_extract(key, "#s([lr])$", 1) == side)


def cluster_members(rows: DataFrame, cluster: str, key: str, centroid: Column, most: int = 10, salt: str = "") -> DataFrame:
    """The centroid and up to ``most`` - 1 other members of each cluster, in hash order: the number is the feature."""
    first = F.concat(F.when(centroid, "0").otherwise("1"), draw(key, salt=salt))
    best = least_rows(rows, cluster, rows.select(cluster).distinct().withColumn("__k", F.lit(most)), first, [key])
    return best.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(first, key)))  # ``most`` rows a cluster


def within_partner(contacts: DataFrame, same: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Adds (l', r) and (l, r') for every contact (l, r) and equivalences l -> l', r -> r' within a partner (columns key, node, twin)."""
    one, two = (within_partner_contacts(contacts, same, key, left, right, side) for side in ("left", "right"))
    return one.unionByName(two).distinct()
