"""Writers: Spark's job commit stands for write-then-rename, so a lost executor leaves no half files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Id columns of pair tables.
PAIR_KEYS = ["chainIdL", "resIdL", "resNameL", "chainIdR", "resIdR", "resNameR"]


def large_enough(rows: DataFrame, chain: list[str], least: int) -> DataFrame:
    """Rows of chains with more than ``least`` rows."""
    big = rows.groupBy(*chain).agg(F.count("*").alias("__n")).filter(F.col("__n") > least).select(*chain)
    return rows.join(big, chain, "left_semi")


def write_feature_table(rows: DataFrame, path: str, by: list[str], order: list[str], sep: str = " ") -> None:
    """Compressed text with headers, a folder per value of ``by``, sorted by ``order`` within; NULL as NaN."""
    rows.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).options(sep=sep, header=True, compression="gzip", nullValue="NaN").csv(path)


def write_results(pairs: DataFrame, sites_l: DataFrame, sites_r: DataFrame, path: str, with_category: bool = True) -> None:
    """Three tables (pairs, lig, rec) by complex; with_category=False leaves categ out."""
    for name, rows, order in (("pairs", pairs, PAIR_KEYS), ("lig", sites_l, ["chainId", "resId"]), ("rec", sites_r, ["chainId", "resId"])):
        write_feature_table(rows if with_category else rows.drop("categ"), f"{path}/{name}", ["complex_id"], order)


def write_lineage(scored: DataFrame, path: str, test: str = "complex_id", train: str = "train_id") -> None:
    """JSON: for every tested complex the complexes that its model has seen."""
    scored.groupBy(test).agg(F.array_sort(F.collect_set(train)).alias("trained_on")).write.mode("overwrite").json(path)


def read_lineage(spark: SparkSession, path: str, test: str = "complex_id") -> DataFrame:
    return spark.read.schema(f"`{test}` string, trained_on array<string>").json(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """A threshold curve, one JSON object per threshold; a curve has as many rows as thresholds asked for."""
    curve.repartitionByRange("threshold").sortWithinPartitions("threshold").write.mode("overwrite").json(path)


def model_path(folder: str, step: str, homo: bool) -> str:
    return f"{folder}/{'homo' if homo else 'hetero'}/{step}"


def save_model(model: PipelineModel, folder: str, step: str, homo: bool) -> None:
    model.write().overwrite().save(model_path(folder, step, homo))


def load_model(folder: str, step: str, homo: bool) -> PipelineModel:
    return PipelineModel.load(model_path(folder, step, homo))


def write_codified(every: DataFrame, sampled: DataFrame, path: str) -> None:
    """Parquet of all pairs and of the sampled ones, as partitions variant=all and variant=sampled."""
    for variant, rows in (("all", every), ("sampled", sampled)):
        rows.write.mode("overwrite").parquet(f"{path}/variant={variant}")


def with_scores_as_b_factor(atoms: DataFrame, scores: DataFrame, score: str = "prediction", factor: float = 1.0, min_max: bool = False) -> DataFrame:
    """Atoms whose b_factor is their residue's score, 0 where it has none.

    scores: complex_id, chain_id, res_id. min_max scales by each complex's least and most score
    (0 where these are equal). Of repeated residues the largest score counts.
    """
    keys = ["complex_id", "chain_id", "res_id"]
    one = scores.groupBy(*keys).agg((F.max(score) * factor).alias("__score"))
    if min_max:
        whole = Window.partitionBy("complex_id")
        low, high = F.min("__score").over(whole), F.max("__score").over(whole)
        one = one.withColumn("__score", F.when(high > low, (F.col("__score") - low) / (high - low)).otherwise(0.0))
    return atoms.join(one, keys, "left").withColumn("b_factor", F.coalesce("__score", F.lit(0.0))).drop("__score")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(file, line_no, line) in fixed columns."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    kind = F.when(F.col("hetflag") == "", "ATOM  ").otherwise("HETATM")
    serial = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) % 100_000
    blank = lambda c: F.rpad(F.coalesce(c, F.lit("")), 1, " ")
    chain = F.when(F.col("chain_id") == "+", " ").otherwise(F.col("chain_id"))
    fields = [kind, serial, name, blank("altloc"), F.lpad("res_name", 3, " "), blank(chain), "res_seq", blank("i_code"), "x", "y", "z", "b_factor", F.lpad("element", 2, " ")]
    text = F.format_string("%s%5d %s%s%s %s%4d%s   %8.3f%8.3f%8.3f  1.00%6.2f          %s", *fields)
    return atoms.select("file", "line_no", text.alias("line"))


def write_structures(atoms: DataFrame, path: str) -> None:
    """One folder per complex, partner and state with its lines in order, as text."""
    by = ["complex_id", "partner", "state"]
    rows = atoms.select("file", "line_no", *by).join(pdb_lines(atoms), ["file", "line_no"])
    rows.repartition(*by).sortWithinPartitions(*by, "line_no").select(F.col("line").alias("value"), *by).write.mode("overwrite").partitionBy(*by).text(path)


def write_sequences(residues: DataFrame, path: str) -> None:
    """FASTA text by chain, and beside it the map from sequence places to residues as Parquet.

    residues: complex_id, partner, chain_id, res_id, res_name, seq_idx.
    """
    by = ["complex_id", "partner", "chain_id"]
    residues.select(*by, "seq_idx", "res_id", "res_name").write.mode("overwrite").parquet(f"{path}/map")
    letters = F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", "res_name"))), lambda x: x["res_name"])
    one = residues.groupBy(*by).agg(F.array_join(letters, "").alias("sequence"))
    one.select(*by, F.concat(F.lit(">"), F.concat_ws("_", *by), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite").partitionBy(*by).text(f"{path}/fasta")


def write_folds(folds: DataFrame, path: str, copies: int = 3) -> None:
    """Folds (fold, part, complex_id) as JSON rows of train and test ids; lower-case ids also stand with -1 to -copies."""
    suffix = F.when(F.col("complex_id") == F.lower("complex_id"), F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))
    rows = folds.withColumn("copy", F.explode(suffix))
    rows = rows.withColumn("complex_id", F.expr("if(copy = 0, complex_id, concat(complex_id, '-', copy))"))
    part = lambda name: F.array_sort(F.collect_set(F.when(F.col("part") == name, F.col("complex_id")))).alias(name)
    rows.groupBy("fold").agg(part("train"), part("test")).repartitionByRange("fold").sortWithinPartitions("fold").write.mode("overwrite").json(path)
