"""Feature tables, results, lists and settings written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import structure_id
from .text import in_file, lines, words


def table_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the first file's header line."""
    head = lines(spark, path).filter("trim(line) != '' and line not like '#%'").orderBy("file", "line_no").first()
    if head is None:
        raise ValueError(f"no table in {path}")
    return head["line"].split()


def read_feature_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Whitespace tables of all files as one, with the file; the columns' order may differ by file.

    Lines that begin with # are comments. A file whose header lacks a column has NULL there, as
    has a value that its type cannot hold. Lines with another number of values than the header
    are left to ``bad_lines``. columns defaults to the first file's header; types to strings.
    """
    rows, types = _split(spark, path).filter("size(parts) = size(names)"), types or {}
    rows = rows.withColumn("row", F.map_from_arrays("names", "parts"))
    value = lambda c: F.try_element_at("row", F.lit(c)).try_cast(types.get(c, "string"))
    return rows.select("file", *[value(c).alias(c) for c in columns or table_columns(spark, path)])


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) with another number of values than the header."""
    return _split(spark, path).filter("size(parts) != size(names)").select("file", "line_no", "line")


def _split(spark: SparkSession, path: str | list[str]) -> DataFrame:
    body = lines(spark, path).filter("trim(line) != '' and line not like '#%'")
    names = F.first(words("line")).over(in_file())
    return body.withColumns({"names": names, "parts": words("line"), "at": F.row_number().over(in_file())}).filter("at > 1")


def read_levels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, column, levels): the categories that ``#Levels: column=a;b;c`` lines declare."""
    rows = lines(spark, path).filter("line like '#Levels:%'").select("file", F.explode(words(F.substring("line", 9, 1 << 20))).alias("item"))
    part = F.split("item", "=", 2)
    return rows.filter("item like '%=%'").select("file", part[0].alias("column"), F.split(part[1], ";").alias("levels"))


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pair scores of earlier runs; categ is NULL where it was left out."""
    kinds = {"categ": "int", "prediction": "double"}
    names = ["chainIdL", "resIdL", "resNameL", "chainIdR", "resIdR", "resNameR", "categ", "prediction"]
    rows = read_feature_table(spark, path, names, kinds)
    return rows.withColumn("complex_id", F.regexp_extract("file", r"([^/]+?)\.res[^/]*$", 1))


def read_families(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(complex_id, side, chain, family) of lines: id, chains and families of both sides (; between chains, : within)."""
    rows = lines(spark, path).filter("trim(line) != '' and line not like '#%'").withColumn("p", words("line")).filter("size(p) >= 5")
    side = lambda name, chains, families: F.struct(F.lit(name).alias("side"), F.split(F.col("p")[chains], ";").alias("chains"), F.split(F.col("p")[families], ";").alias("families"))
    rows = rows.select(F.col("p")[0].alias("complex_id"), F.explode(F.array(side("L", 1, 3), side("R", 2, 4))).alias("s"))
    rows = rows.select("complex_id", "s.side", F.explode(F.arrays_zip(F.col("s.chains").alias("chain"), F.col("s.families").alias("family"))).alias("z"))
    return rows.select("complex_id", "side", "z.chain", F.explode(F.split("z.family", ":")).alias("family")).distinct()


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, part, complex_id) of a JSON list of {"train": [...], "test": [...]}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<train:array<string>,test:array<string>>>").alias("folds"))
    rows = text.select(F.posexplode("folds").alias("fold", "f"))
    part = lambda name: rows.select("fold", F.lit(name).alias("part"), F.explode(f"f.{name}").alias("complex_id"))
    return part("train").union(part("test"))


def uncovered(folds: DataFrame, complexes: DataFrame) -> DataFrame:
    """Complexes that no fold tests."""
    return complexes.select("complex_id").distinct().join(folds.filter("part = 'test'"), "complex_id", "left_anti")


def read_pair_list(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects) of lines ``id:chain,id:chain``; # and > begin comments."""
    rows = lines(spark, path).filter("trim(line) != '' and not line rlike '^\\\\s*[#>]'")
    item = lambda k: structure_id(F.trim(F.get(F.split("line", ","), F.lit(k))))
    rows = rows.select("file", "line_no", "line", item(0).alias("ligand"), item(1).alias("receptor"), F.size(F.split("line", ",")).alias("n"))
    good = F.expr("n = 2 and ligand.id is not null and receptor.id is not null")
    return rows.filter(F.coalesce(good, F.lit(False))).drop("n", "line"), rows.filter(~F.coalesce(good, F.lit(False))).select("file", "line_no", "line")


def read_chain_list(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(complex_id, chains_l, chains_r of every line ``id chains chains``, rejects); chains are single letters in a row."""
    rows = lines(spark, path).filter("trim(line) != '' and not line rlike '^\\\\s*[#>]'").withColumn("p", words("line"))
    chains = lambda k: F.split(F.col("p")[k], "(?!^)(?=.)")
    good = rows.filter("size(p) = 3").select(F.col("p")[0].alias("complex_id"), chains(1).alias("chains_l"), chains(2).alias("chains_r"))
    return good, rows.filter("size(p) != 3").select("file", "line_no", "line")


def read_restricted_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(complex_id, chain_id), each once, of lines ``name id_chain id_chain ...``: what an evaluation is restricted to."""
    items = lines(spark, path).select(F.explode(F.slice(words("line"), 2, 1 << 30)).alias("item")).filter("item like '%\\_%'")
    return items.select(F.substring_index("item", "_", 1).alias("complex_id"), F.substring_index("item", "_", -1).alias("chain_id")).distinct()


def read_catalogue(spark: SparkSession, path: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The catalogue of known profiles (sequence, structure id, chain, status): Parquet, or a table by JDBC options."""
    return spark.read.format("jdbc").options(url=path, **jdbc).load() if jdbc else spark.read.parquet(path)


def read_poses(spark: SparkSession, path: str | list[str], top: int = 10) -> DataFrame:
    """(file, rank, score, area, transform) of docking poses: bar-separated lines, the ``top`` ranks of each file (the feature)."""
    part = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = lines(spark, path).filter(r"line rlike '^\\s*\\d+\\s*\\|'").withColumn("p", part)
    moves = F.transform(words(F.element_at("p", -1)), lambda x: x.try_cast("double"))
    rows = rows.select("file", F.col("p")[0].cast("int").alias("rank"), F.get("p", F.lit(1)).try_cast("double").alias("score"), F.slice(moves, 1, 3).alias("rotation"), F.slice(moves, 4, 3).alias("translation"))
    return rows.filter(F.col("rank") <= top)


def read_log_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row of metrics per complex from run logs: the line after each header ``pdb auc_pair ...``; the last of an id holds."""
    rows = lines(spark, path).withColumn("names", F.lag("line").over(in_file())).filter(r"names rlike '^\\s*pdb\\s+auc_pair'")
    rows = rows.select("file", "line_no", words("names").alias("names"), words("line").alias("p"))
    # a log may print a line number before the values
    rows = rows.withColumn("p", F.slice("p", F.size("p") - F.size("names") + 1, F.size("names"))).filter("size(p) = size(names)")
    last = rows.withColumn("complex_id", F.col("p")[0]).groupBy("complex_id").agg(F.max_by(F.map_from_arrays("names", "p"), F.struct("file", "line_no")).alias("row"))
    names = ["auc_pair", "prec_50", "reca_50", "prec_100", "reca_100", "prec_500", "reca_500", "auc_bs", "prec_bs", "reca_bs", "mcc_bs"]
    return last.select("complex_id", *[F.try_element_at("row", F.lit(c)).try_cast("double").alias(c) for c in names])


def with_mean_row(metrics: DataFrame, key: str = "complex_id") -> DataFrame:
    """Sorted rows and, last, their mean under the key ``mean``."""
    values = [c for c in metrics.columns if c != key]
    mean = metrics.agg(*[F.avg(c).alias(c) for c in values]).select(F.lit("mean").alias(key), *values, F.lit(1).alias("last"))
    return metrics.select(key, *values, F.lit(0).alias("last")).union(mean).orderBy("last", key).drop("last")
