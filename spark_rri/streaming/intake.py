"""Incremental intake: only what has not been processed yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Batch form: rows whose keys are not in the output."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a table: a folder, or a single file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return files.option("pathGlobFilter", name).parquet(folder)
    return files.parquet(path)


def available_now(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame], target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run ``work`` over the files of a table (a folder, or a single file) that the checkpoint has not seen, then return all output.

    Called again with the same target and checkpoint it takes new files only. Both folders are
    by default fresh ones under spark.checkpoint.dir.
    """
    target = target or fresh_path(spark, "intake")
    checkpoint = checkpoint or fresh_path(spark, "seen")
    query = work(stream_of(spark, path)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(work(spark.read.parquet(path)).schema).parquet(target)


def quarantine(rows: DataFrame, rejects: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a rejected complex takes its sub-fold siblings (same key before @) with it."""
    base = F.split(F.col(key), "@")[0]
    bad = rejects.select(base.alias("__base"), "reason").groupBy("__base").agg(F.min("reason").alias("reason"))
    marked = rows.withColumn("__base", base).join(bad, "__base", "left")
    return marked.filter("reason is null").drop("__base", "reason"), marked.filter("reason is not null").drop("__base")
