"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine sets none (tests), a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def with_checkpoints(spark: SparkSession) -> None:
    """Sets the folder of checkpoint() where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows, read back from a table written to the shared folder, in buckets of the columns ``by`` if any.

    What made them is not run again, and joins and groupings by just these columns need no exchange.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stored")
    if not by:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name, n = f"stored_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def enough_parts(rows: DataFrame, a_task: int) -> int:
    """So many partitions that about ``a_task`` of the rows meet in each; at least spark.sql.shuffle.partitions.

    A table read from Parquet is counted by its files' footers.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // a_task))
