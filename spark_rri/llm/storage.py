"""Written tables that cut lineage, in the shared folder the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that crosses to Python; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes of Parquet files up to which a side table goes to all tasks, and its rows.
SIDE_BYTES, SIDE_ROWS = 32 << 20, 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine sets none (tests), a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame; batches that cross to Python in its session hold at most ``BATCH_BYTES``, as texts are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


class Scratch:
    """Parquet tables of one query under the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.serial = 0

    def save(self, df: DataFrame) -> DataFrame:
        """The rows, read back from a written table: whatever made them is not run again."""
        self.serial += 1
        path = f"{self.root}/{self.serial}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark's cleaner find the shuffle files of steps whose results are saved."""
        gc.collect()
        self.spark._jvm.System.gc()

    def path_of(self, df: DataFrame) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        files, path = self.path_of(df)
        files.delete(path, True)

    def beside(self, df: DataFrame) -> DataFrame:
        """A side table, saved, for joining with texts: sent to all tasks up to ``SIDE_BYTES`` and ``SIDE_ROWS``, else joined by shuffling."""
        saved = self.save(df)
        files, path = self.path_of(saved)
        small = files.getContentSummary(path).getLength() <= SIDE_BYTES and saved.count() <= SIDE_ROWS
        return F.broadcast(saved) if small else saved
