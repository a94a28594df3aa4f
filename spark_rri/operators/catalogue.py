"""A catalogue of results that are computed once for each key and found by every later run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..shared import stored

#: Files of a catalogue by its keys' hash; an update writes again only those that its keys fall into.
PIECES = 64


def read_entries(spark: SparkSession, path: str, schema) -> DataFrame:
    """The catalogue's entries; none before the first update."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert(entries: DataFrame, path: str, key: str, pieces: int = PIECES) -> None:
    """Adds entries to the catalogue or puts them in place of those with the same key.

    The pieces they fall into are joined with the entries, written aside, and then put in place by
    overwriting just these partitions; the same call again leaves the same catalogue. A key
    occurs once in ``entries`` and is not NULL.
    """
    spark = entries.sparkSession
    new = stored(entries.withColumn("piece", F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")))
    touched = [r[0] for r in new.select("piece").distinct().collect()]  # ``pieces`` at most
    known = read_entries(spark, path, new.schema).filter(F.col("piece").isin(touched)).join(new.select(key), key, "left_anti")
    whole = stored(known.select(*new.columns).unionByName(new))
    whole.repartition("piece").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("piece").parquet(path)


def filled(rows: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with their keys' entries and an origin: ``catalogue`` if the entry was there before this call, else ``computed``.

    Only keys without an entry go to ``compute``, each once, whatever the rows that hold it; it returns
    key, value columns and ``status`` (0 for success), one row for each key. What it returns is
    written to the catalogue before the rows are read, failures with their status too, so no
    later call computes them again. A key that ``compute`` leaves out, and a NULL key, has no entry (origin NULL).
    """
    todo = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    shape = compute(todo.limit(0)).schema
    stored_shape = StructType([*shape.fields, StructField("piece", IntegerType())])
    known = read_entries(rows.sparkSession, path, stored_shape).drop("piece")
    fresh = stored(compute(todo.join(known.select(key), key, "left_anti")))
    before = stored(known.join(todo, key, "left_semi"))
    if not fresh.isEmpty():
        upsert(fresh, path, key)
    entries = before.withColumn("origin", F.lit("catalogue")).unionByName(fresh.withColumn("origin", F.lit("computed")))
    return rows.join(entries, key, "left")
