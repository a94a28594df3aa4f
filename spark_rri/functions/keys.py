"""Column functions on residue names, ids and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One-letter codes of the standard residues and of frequent modified ones.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "H1S": "H", "H2S": "H", "H3S": "H", "MSE": "M", "PTR": "T", "TPO": "T", "SEP": "S", "HYP": "P", "TYS": "T", "MLZ": "K", "MLY": "K", "M3L": "K",
}
LETTERS = "ABCDEFGHIKLMNPQRSTVWXYZ"


def one_letter(name: Column, more: dict[str, str] | None = None) -> Column:
    """NULL for water, X for what is not listed; ``more`` adds codes or puts others in their place."""
    table = F.create_map(*[F.lit(x) for kv in (RESIDUES | (more or {})).items() for x in kv])
    name = F.upper(F.trim(name))
    return F.when(name != "HOH", F.coalesce(F.try_element_at(table, name), F.lit("X")))


def residue_id(number: Column, insertion: Column) -> Column:
    return F.trim(F.concat(number.cast("string"), F.coalesce(insertion, F.lit(""))))


def residue_order(res_id: Column) -> Column:
    """Sorts ids by number, then insertion code."""
    return F.struct(F.regexp_extract(res_id, r"(-?\d+)(\D?)", 1).cast("int").alias("number"), F.regexp_extract(res_id, r"(-?\d+)(\D?)", 2).alias("insertion"))


def base_id(key: Column) -> Column:
    """The key before any of : - @ #, in upper case."""
    return F.upper(F.split(key, "[:@#-]")[0])


def key_parts(key: Column) -> Column:
    """Struct of prefix, chains, side and state of keys such as 1abc_l_b or 1abc_A, split at _; a part that is missing is NULL.

    A last part #sl or #sr tells which side of a mixed complex is a sequence.
    """
    parts = F.split(F.regexp_replace(key, "#s[lr]$", ""), "_")
    return F.struct(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("second"), F.get(parts, F.lit(2)).alias("third"), F.nullif(F.regexp_extract(key, "#(s[lr])$", 1), F.lit("")).alias("mixed"))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def structure_id(text: Column) -> Column:
    """Struct of id, chain and biological unit, NULL id where the grammar does not match."""
    pattern = r"^(\d[a-zA-Z0-9]{3})(?::([A-Za-z0-9+*]))?(?:_(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("id"), part(2).alias("chain"), part(3).alias("unit"))


def clean_sequence(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def valid_sequence(seq: Column) -> Column:
    return seq.rlike(f"^[{LETTERS}]+$")


def alignment_quality(seq: Column) -> Column:
    """Length without gaps and lower-case letters."""
    return F.length(F.regexp_replace(seq, "[-a-z]", ""))


def without_insertions(seq: Column) -> Column:
    """The aligned sequence without lower-case letters."""
    return F.regexp_replace(seq, "[a-z]", "")


def identity(a: Column, b: Column) -> Column:
    """Share of equal places over the aligned length; NULL for empty sequences."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    same = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return same / F.nullif(F.length(a), F.lit(0))


def overlap_fraction(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Share of interval a that b covers."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)) / F.nullif(a_end - a_start, F.lit(0))


def display_chain(chain: Column) -> Column:
    return F.when(chain == "*", " ").otherwise(chain)
