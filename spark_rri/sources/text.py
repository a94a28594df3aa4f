"""Bulk text scans: one job over all files of a path, never one job a file.

A file is one row until it is split, so the files must each fit a task; there may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partner (l, r) and state (b, u) in a file's name.
NAME = r"([^/]+)_([lr])_([bu])\.[^/]*$"


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text), compressed files unpacked, line ends as \\n."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line), numbered from 0 in each file."""
    return whole_files(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def words(line: Column | str) -> Column:
    """The parts of a line between white space."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def in_file(*more: str):
    """A window over a file's lines in their order."""
    return Window.partitionBy("file", *more).orderBy("line_no")


def with_file_keys(rows: DataFrame) -> DataFrame:
    """Adds complex_id, partner and state from names such as 1abc_l_b.pdb; NULL where the name does not match."""
    part = lambda k: F.nullif(F.regexp_extract("file", NAME, k), F.lit(""))
    return rows.withColumns({"complex_id": part(1), "partner": part(2), "state": part(3)})


def complete_inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete complexes, rejects with a reason), from the keys of with_file_keys.

    A complex needs both partners in the bound state; unbound files count for both or none.
    """
    has = lambda partner, state: F.bool_or(F.expr(f"partner = '{partner}' and state = '{state}'")).alias(partner + state)
    seen = files.filter("complex_id is not null").groupBy("complex_id").agg(has("l", "b"), has("r", "b"), has("l", "u"), has("r", "u"))
    reason = F.expr("case when not (lb and rb) then 'bound partner missing' when lu != ru then 'unbound partner missing' end")
    named = seen.select("complex_id", (F.col("lu") & F.col("ru")).alias("has_unbound"), reason.alias("reason"))
    unnamed = files.filter("complex_id is null").select(F.col("file").alias("complex_id"), F.lit("name does not match").alias("reason")).distinct()
    return named.filter("reason is null").drop("reason"), named.filter("reason is not null").select("complex_id", "reason").union(unnamed)
