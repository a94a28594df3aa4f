"""Per-residue profiles and predictions of other programs, as tables keyed by file and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import one_letter
from .text import in_file, lines, words

#: The numbers of a surface table, in its order.
SURFACE = [
    "total_ASA", "b_bone_ASA", "s_chain_ASA", "polar_ASA", "n_polar_ASA",
    "total_RASA", "b_bone_RASA", "s_chain_RASA", "polar_RASA", "n_polar_RASA",
    "average_DPX", "s_avg_DPX", "s_ch_avg_DPX", "s_ch_s_avg_DPX", "max_DPX", "min_DPX",
    "average_CX", "s_avg_CX", "s_ch_avg_CX", "s_ch_s_avg_CX", "max_CX", "min_CX", "Hydrophobicity",
]


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: x.try_cast("double"))


def _numbered(spark: SparkSession, path: str | list[str], least: int) -> DataFrame:
    """Lines that begin with a residue's number and have enough parts."""
    return lines(spark, path).filter(r"line rlike '^\\s*\\d+\\s'").withColumn("p", words("line")).filter(F.size("p") >= least)


def read_pssm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_idx, letter, pssm, psfm, ipp, rwgrmp): 20 scores, 20 shares and two numbers per place."""
    p = F.col("p")
    rows = _numbered(spark, path, 44).filter(p[1].rlike("^[A-Z]$"))
    return rows.select("file", (p[0].cast("int") - 1).alias("seq_idx"), p[1].alias("letter"), _numbers(F.slice(p, 3, 20)).alias("pssm"), _numbers(F.slice(p, 23, 20)).alias("psfm"), p[42].try_cast("double").alias("ipp"), p[43].try_cast("double").alias("rwgrmp"))


def read_hhm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_idx, letter, profile): 31 numbers of each residue's two lines, -1 for *.

    A residue's line has 23 parts, of which the first two name it; the line behind it has ten more.
    """
    rows = lines(spark, path).withColumns({"p": words("line"), "behind": words(F.coalesce(F.lead("line").over(in_file()), F.lit("")))})
    p = F.col("p")
    rows = rows.filter((F.size("p") == 23) & (F.size("behind") == 10) & p[0].rlike("^[A-Z]$") & p[1].rlike(r"^\d+$"))
    value = F.transform(F.concat(F.slice("p", 3, 21), F.col("behind")), lambda x: F.when(x == "*", F.lit(-1.0)).otherwise(x.try_cast("double")))
    return rows.select("file", (p[1].cast("int") - 1).alias("seq_idx"), p[0].alias("letter"), value.alias("profile"))


def read_conservation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_idx, letter, score) of lines: number, letter, score; NULL where the score is no number."""
    p = F.col("p")
    return _numbered(spark, path, 3).select("file", (p[0].cast("int") - 1).alias("seq_idx"), p[1].alias("letter"), p[2].try_cast("double").alias("score"))


def read_predicted_surface(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_idx, letter, pred_asa, p_c, p_e, p_h) of predictions from the sequence."""
    p = F.col("p")
    number = {"pred_asa": 3, "p_c": 8, "p_e": 9, "p_h": 10}
    return _numbered(spark, path, 11).select("file", (p[0].cast("int") - 1).alias("seq_idx"), p[1].alias("letter"), *[p[k].try_cast("double").alias(c) for c, k in number.items()])


def read_surface(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, chain_id, res_id, res_name, 23 numbers) of tables with eight lines before the first row; chain * is +, water goes."""
    rows = lines(spark, path).filter("line_no >= 8").withColumn("p", words("line")).filter(F.size("p") >= 8 + len(SURFACE))
    p = F.col("p")
    chain = F.when(p[0] == "*", "+").otherwise(p[0])
    rows = rows.select("file", chain.alias("chain_id"), p[6].alias("res_id"), one_letter(p[7]).alias("res_name"), *[p[8 + k].try_cast("double").alias(c) for k, c in enumerate(SURFACE)])
    return rows.filter("res_name is not null")


def read_coupling_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, i, j, score) of dense matrices, both places from 0."""
    rows = lines(spark, path).filter("trim(line) != ''").withColumn("i", F.row_number().over(in_file()) - 1)
    return rows.select("file", "i", F.posexplode(_numbers(words("line"))).alias("j", "score"))


def read_coupling_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same of lines ``i j score`` with places from 1."""
    p = F.col("p")
    return _numbered(spark, path, 3).select("file", (p[0].cast("int") - 1).alias("i"), (p[1].cast("int") - 1).alias("j"), p[2].try_cast("double").alias("score"))
