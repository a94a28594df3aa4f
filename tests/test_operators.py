"""Micro fixtures worked out by hand."""

from pyspark.sql import functions as F

from spark_rri.functions import keys
from spark_rri.operators import evaluation, ordered, sampling, spatial
from spark_rri.streaming.intake import quarantine


def test_cell_border(spark):
    rows = [(0, 0, 1, 0.0, 0.0, 0.0), (0, 1, 2, 6.0, 0.0, 0.0), (0, 1, 3, 6.001, 0.0, 0.0), (0, 1, 4, -3.0, -3.0, -3.0), (0, 1, 5, -5.0, -5.0, 0.0)]
    p = spark.createDataFrame(rows, "complex_id int, partner int, node int, x double, y double, z double")
    got = {(r["node_l"], r["node_r"]) for r in spatial.contact_pairs(p, 6.0).collect()}
    assert got == {(1, 2), (1, 4)}


def test_smooth_short_chains(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 2.0)], "c string, i int, s double")
    got = {(r["c"], r["i"]): r["smoothed"] for r in ordered.smooth(rows, "c", ["i"], "s").collect()}
    assert got == {("a", 1): 1.6, ("b", 1): 2.0, ("b", 2): 2.0 + 7 / 5}


def test_auc_one_class_and_ties(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 0.0, 0), ("b", 1.0, 1)], "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in evaluation.roc_auc(rows, "g", "s", "y").collect()}
    assert got == {"a": 0.75, "b": 0.5}


def test_negative_sampling_counts(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {(r["g"], r["y"]): r["count"] for r in sampling.negative_sampling(rows, "g", "y", ["id"], 3).groupBy("g", "y").count().collect()}
    assert got == {(0, 1): 10, (0, 0): 30}


def test_keys(spark):
    row = spark.range(1).select(keys.one_letter(F.lit("mse")).alias("a"), keys.one_letter(F.lit("HOH")).alias("b"), keys.one_letter(F.lit("ZZZ")).alias("c"), keys.base_id(F.lit("1abc:A")).alias("d"), keys.identity(F.lit("ABCD"), F.lit("ABXD")).alias("e"), keys.alignment_quality(F.lit("AB-cD")).alias("f"), keys.structure_id(F.lit("1acb:E_1")).alias("g")).first()
    assert row[:6] == ("M", None, "X", "1ABC", 0.75, 3) and tuple(row["g"]) == ("1acb", "E", "1")


def test_quarantine_takes_siblings(spark):
    rows = spark.createDataFrame([("x@1",), ("x@2",), ("y@1",)], "k string")
    kept, gone = quarantine(rows, spark.createDataFrame([("x@1", "bad")], "k string, reason string"), "k")
    assert [r["k"] for r in kept.collect()] == ["y@1"] and gone.count() == 2


def test_ranks_without_group_windows(spark):
    from pyspark.sql import Window

    from spark_rri.operators import scoring

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 50 == 1, "b").otherwise("a").alias("g"), "id", F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("id") * 7 % 40 / 4.0).alias("s"), (F.col("id") % 11 == 10).cast("int").alias("y"))
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id")))
    want = {r["id"]: r["rank"] for r in plain.collect()}
    assert {r["id"]: r["rank"] for r in scoring.ranked(rows, "g", "s", ["id"]).collect()} == want
    assert {r["id"]: r["rank"] for r in scoring.top_rows(rows, "g", "s", ["id"], 30).collect()} == {k: v for k, v in want.items() if v <= 30}
    assert {r["id"] for r in scoring.among_best(rows, "g", "s", ["id"], 30, "best").filter("best").collect()} == {k for k, v in want.items() if v <= 30}
    assert {r["g"]: r["first_rank"] for r in evaluation.first_hits(rows, "g", "s", ["id"], "y").collect()} == {r["g"]: r["f"] for r in plain.groupBy("g").agg(F.min(F.when(F.col("y") == 1, F.col("rank"))).alias("f")).collect()}
