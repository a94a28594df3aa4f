"""Choosing rows before pairs are formed: atoms, residues, partners, chains, ids and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import RESIDUES


def without_columns(rows: DataFrame, names: tuple[str, ...] = ("seqIndex",)) -> DataFrame:
    """The rows without columns that are never features; names that are missing do no harm."""
    return rows.drop(*names)


def known_residues(rows: DataFrame, letter: str) -> DataFrame:
    """Rows of residues with a letter of their own; X and missing letters go."""
    return rows.filter(F.coalesce(F.col(letter), F.lit("X")) != "X")


def heavy_atoms(atoms: DataFrame, atom: str = "atom_name", residue: str = "res_name") -> DataFrame:
    """Atoms of amino acids other than hydrogens, which are named H...; water is no amino acid."""
    return atoms.filter(F.upper(F.trim(residue)).isin(list(RESIDUES)) & ~F.upper(F.trim(atom)).startswith("H"))


def sized(rows: DataFrame, keys: list[str], entity: list[str], least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): rows of groups with more than ``least`` and fewer than ``most`` distinct entities, and the other groups with their sizes and a reason."""
    sizes = rows.groupBy(*keys).agg(F.count_distinct(*entity).alias("size"))
    bad = F.when(F.col("size") <= least, "too few").when(F.col("size") >= most, "too many")
    rejects = sizes.withColumn("reason", bad).filter("reason is not null")
    return rows.join(rejects.select(*keys), keys, "left_anti"), rejects


def accessible(rows: DataFrame, relative_area: str, over: float = 10.0) -> DataFrame:
    """Residues of which more than ``over`` percent of the surface is accessible; unknown areas go."""
    return rows.filter(F.col(relative_area) > over)


def evaluated(rows: DataFrame, key: str) -> DataFrame:
    """Complexes to evaluate: the first four characters of the id are in upper case; others are for training only."""
    head = F.substring(key, 1, 4)
    return rows.filter(head == F.upper(head))


def listed(rows: DataFrame, ids: DataFrame, keys: list[str], inverted: bool = False) -> DataFrame:
    """Rows whose keys are (or, inverted, are not) in the list of ids or chains, which may repeat."""
    return rows.join(ids.select(*keys), keys, "left_anti" if inverted else "left_semi")


def not_touching(chains: DataFrame, contacts: DataFrame, keys: list[str], chain: str, ends: tuple[str, str]) -> DataFrame:
    """Chains that no contact names at either end."""
    met = contacts.select(*keys, F.explode(F.array(*ends)).alias(chain))
    return chains.join(met, [*keys, chain], "left_anti")


def product_terms(rows: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Adds the product of every left column with every right one."""
    return rows.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a in left for b in right})


def encoded_letters(rows: DataFrame, letter: str, factors: DataFrame) -> DataFrame:
    """Adds a letter's factors by a table (letter, f1, f2, ...) of one row per letter; unknown letters get NULL."""
    side = factors.withColumnRenamed("letter", "__letter")
    return rows.join(side, F.col(letter) == F.col("__letter"), "left").drop("__letter")


def one_hot(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Adds 1 or 0 for each of the fixed levels, named column_level; other values give zeros."""
    return rows.withColumns({f"{column}_{x}": F.coalesce((F.col(column) == x).cast("int"), F.lit(0)) for x in levels})


def gap_letter(letter: Column) -> Column:
    """The letter, X for a gap."""
    return F.translate(letter, "-", "X")


def with_chain_length(rows: DataFrame, keys: list[str], entity: list[str], out: str = "seqLen") -> DataFrame:
    """Adds how many distinct entities the row's chain has."""
    return rows.join(rows.groupBy(*keys).agg(F.count_distinct(*entity).alias(out)), keys)
