"""The driver's tables in the roles of points, chains, scored pairs and labelled scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = ["x", "y", "z", "ax", "ay", "az", "v1", "v2", "v3"]
    cols = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(axes)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.expr("cast(label div 2 as int)").alias("complex_id"), F.expr("label % 2").alias("partner"), F.col("label").alias("chain"), *cols)


POINTS = "points AS (SELECT vec_id AS node, label // 2 AS complex_id, label % 2 AS partner, label AS chain, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate(["x", "y", "z", "ax", "ay", "az", "v1", "v2", "v3"])) + " FROM embeddings)"
D2 = "((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z))"


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("complex_id"), F.col("l_suppkey").alias("site_l"), F.col("l_partkey").alias("site_r"), F.col("l_extendedprice").alias("score"), "l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("label"))


PAIRS = "pairs AS (SELECT l_linenumber AS complex_id, l_suppkey AS site_l, l_partkey AS site_r, l_extendedprice AS score, l_orderkey, (l_returnflag = 'R')::INT AS label FROM lineitem)"
TIES = ["l_orderkey", "site_r", "site_l"]
RANKED = PAIRS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY score DESC, l_orderkey, site_r, site_l) AS rank FROM pairs)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"), "toxic")


SCORES = "scores AS (SELECT l.doc_id, d.lang, d.source, d.n_chars::DOUBLE AS score, l.quality AS label, l.toxic FROM labels l JOIN documents d USING (doc_id))"
