"""Registered queries of the file readers and writers: the driver's tables, written in a format and read back."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..sources import sinks, tables
from .queries import query
from .standins import table


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names."""
    return shared.fresh_path(spark, "written")


@query("SELECT c_nationkey, c_custkey, c_mktsegment, c_acctbal::DOUBLE AS c_acctbal FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 5)")
def feature_table_round_trip(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = fresh_path(spark)
    sinks.write_feature_table(sinks.large_enough(c, ["c_nationkey"], 5), path, ["c_nationkey"], ["c_custkey"], sep="\t")
    back = tables.read_feature_table(spark, f"{path}/*", ["c_custkey", "c_mktsegment", "c_acctbal"], {"c_custkey": "long", "c_acctbal": "double"})
    nation = F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("int")
    return back.select(nation.alias("c_nationkey"), "c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT l_suppkey::VARCHAR AS supplier, list_sort(list(DISTINCT l_partkey::VARCHAR))::VARCHAR AS parts FROM lineitem GROUP BY 1")
def lineage_round_trip(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_partkey").cast("string").alias("train_id"))
    path = fresh_path(spark)
    sinks.write_lineage(l, path, test="supplier")
    back = sinks.read_lineage(spark, path, test="supplier")
    return back.select("supplier", F.concat(F.lit("["), F.array_join("trained_on", ", "), F.lit("]")).alias("parts"))


@query("SELECT o_orderpriority AS variant_of, 'all' AS variant, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderpriority, 'sampled', o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def codified_round_trip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = fresh_path(spark)
    sinks.write_codified(o, o.filter("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path).select(F.col("o_orderpriority").alias("variant_of"), "variant", "o_orderkey", "o_orderstatus")
