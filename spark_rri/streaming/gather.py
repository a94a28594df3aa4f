"""Complexes whose variants arrive in parts: held until they are whole, quarantined when they stay behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from .intake import stream_of

STATES = ("complete", "waiting", "quarantined")


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that left a table of waiting rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/waiting")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(at) if "=" in f.getPath().getName())


def state_table(spark: SparkSession, folder: str, state: str, schema, numbers: list[int]) -> DataFrame:
    """The rows that the batches left in a state."""
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{state}/batch={n}" for n in numbers])


def gather(spark: SparkSession, path: str, folder: str, key: str, variant: str, variants: list, arrived: str, deadline: float, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """Takes the files that have come since the last call with this folder; returns the rows of every state with a reason.

    The rows of a complex (column key) are ``complete`` once each of ``variants`` has come, with all rows
    that came so far, and ``waiting`` before; they are ``quarantined`` once the latest arrival of any
    complex (a timestamp) is more than ``deadline`` seconds after its own first one. What comes later for a
    complete or quarantined complex shares its state. Rows with a NULL key are quarantined; a NULL
    arrival counts as the latest. Rows are counted by complex in partial sums, so a complex may have any number.

    ``prepare`` makes the rows' columns from the files'. The folder holds one table for each batch and state. A batch reads what batches before it left
    and overwrites only its own tables, so one that is run again after a failure leaves the same.
    """
    source = prepare(spark.read.parquet(path)).schema
    kind = source[variant].dataType.simpleString()
    told = spark.createDataFrame([], source).withColumn("reason", F.lit(None).cast("string")).schema
    clock = "latest timestamp"

    def take(rows: DataFrame, number: int) -> None:
        past = [n for n in batches(spark, folder) if n < number]
        before = state_table(spark, folder, "waiting", told, past[-1:]).drop("reason")
        now = stored(rows.unionByName(before))
        times = now.select(F.col(arrived).cast("timestamp").alias("latest")).unionByName(state_table(spark, folder, "latest", clock, past[-1:]))
        latest = stored(times.agg(F.max("latest").alias("latest")))
        met = F.size(F.array_intersect(F.collect_set(variant), F.lit(list(variants)).cast(f"array<{kind}>")))
        seen = now.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(met.alias("__n"), F.min(F.col(arrived).cast("timestamp")).alias("__first"))
        for state in ("complete", "quarantined"):
            old = state_table(spark, folder, state, told, past).select(F.col(key).alias("__old")).filter("__old is not null").distinct()
            seen = seen.join(old.withColumn(f"__{state}", F.lit(True)), F.col("__key") == F.col("__old"), "left").drop("__old")
        seen = seen.join(F.broadcast(latest))  # one row
        late = F.unix_timestamp("latest") - F.unix_timestamp("__first") > deadline
        few = F.concat_ws(" ", F.col("__n").cast("string"), F.lit(f"of {len(set(variants))} variants"))
        reason = F.when(F.col("__key").isNull(), "no key").when(F.col("__quarantined"), "came after quarantine").when(F.col("__complete") | (F.col("__n") == len(set(variants))), None).when(late, few)
        done = F.coalesce(F.col("__complete"), F.lit(False)) | (F.col("__n") == len(set(variants)))
        marked = now.join(seen, F.col(key) == F.col("__key"), "left").withColumn("reason", reason)
        marked = stored(marked.withColumn("__state", F.when(F.col("reason").isNotNull(), "quarantined").when(done, "complete").otherwise("waiting")).select(*told.names, "__state"))
        latest.write.mode("overwrite").parquet(f"{folder}/latest/batch={number}")
        for state in STATES:
            marked.filter(F.col("__state") == state).drop("__state").write.mode("overwrite").parquet(f"{folder}/{state}/batch={number}")

    prepare(stream_of(spark, path)).writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/seen").trigger(availableNow=True).start().awaitTermination()
    made = batches(spark, folder)
    return {state: state_table(spark, folder, state, told, made[-1:] if state == "waiting" else made) for state in STATES}
