"""Sequences, alignments and search reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_sequence, valid_sequence
from .text import in_file, lines, whole_files, with_file_keys


def read_fasta(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(sequences, rejects): one record a file, in capitals, without white space.

    Rejected with a reason: no sequence, several records, a letter outside the alphabet.
    """
    head = r"(?m)^>([^\n]*)$"
    files = with_file_keys(whole_files(spark, path))
    rows = files.withColumns({"n_records": F.regexp_count("text", F.lit(r"(?m)^>")), "header": F.regexp_extract("text", head, 1), "sequence": clean_sequence(F.regexp_replace("text", head, ""))})
    reason = F.when(F.col("n_records") > 1, "several records").when(F.col("sequence") == "", "no sequence").when(~valid_sequence(F.col("sequence")), "letter outside the alphabet")
    rows = rows.withColumn("reason", reason).select("file", "complex_id", "partner", "state", "header", "sequence", "reason")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("file", "complex_id", "partner", "reason")


def read_a3m(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, position, header, taxon, sequence) of aligned records; the first of a file has position 0.

    The taxon follows OS= or stands in square brackets, else NULL.
    """
    rows = lines(spark, path).filter("trim(line) != '' and line not like '#%'").withColumn("starts", F.col("line").startswith(">"))
    rows = rows.withColumn("position", F.sum(F.col("starts").cast("int")).over(in_file()) - 1).filter("position >= 0")
    parts = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line_no", F.trim("line").alias("part")))))
    one = rows.groupBy("file", "position").agg(F.max(F.expr("case when starts then substring(line, 2) end")).alias("header"), parts.alias("parts"))
    taxon = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("header", p, 1)), F.lit("")) for p in (r"OS=(.+?)(?:\s[A-Z]{2}=|$)", r"\[([^\]]+)\]")])
    return one.select("file", "position", "header", taxon.alias("taxon"), F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("sequence"))


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per local alignment of a search report: spans, aligned sequences, identity in percent, e-value, round."""
    rounds = whole_files(spark, path).select("file", F.regexp_extract("text", r"Length\s*=\s*(\d+)|\(([\d,]+) letters", 1).alias("l1"), F.regexp_extract("text", r"\(([\d,]+) letters", 1).alias("l2"), F.explode(F.split("text", r"Results from round ")).alias("part"))
    rounds = rounds.select("file", F.expr("try_cast(replace(if(l2 != '', l2, l1), ',', '') as int)").alias("query_length"), F.expr(r"coalesce(try_cast(regexp_extract(part, '^(\\d+)', 1) as int), 1)").alias("round"), "part")
    targets = rounds.select("file", "query_length", "round", F.posexplode(F.split("part", r"\n>")).alias("target_no", "target")).filter("target_no > 0")
    targets = targets.select("file", "query_length", "round", "target_no", F.regexp_extract("target", r"^\s*(\S+)", 1).alias("target_id"), F.posexplode(F.split("target", r"\n\s*Score\s*=")).alias("hit_no", "hit")).filter("hit_no > 0")
    spans = lambda side, k: F.regexp_extract_all("hit", F.lit(rf"(?m)^{side}:?\s+(\d+)\s+([A-Za-z*-]+)\s+(\d+)"), F.lit(k))
    low = lambda side: F.array_min(spans(side, 1).cast("array<int>"))
    high = lambda side: F.array_max(spans(side, 3).cast("array<int>"))
    raw_e = F.regexp_extract("hit", r"Expect(?:\(\d+\))?\s*=\s*([\d.eE+-]+\d)", 1)
    return targets.select(
        "file", "round", "query_length", "target_no", "target_id", "hit_no",
        low("Query").alias("query_start"), high("Query").alias("query_end"), low("Sbjct").alias("target_start"), high("Sbjct").alias("target_end"),
        F.array_join(spans("Query", 2), "").alias("query_seq"), F.array_join(spans("Sbjct", 2), "").alias("target_seq"),
        F.when(raw_e.startswith("e"), F.concat(F.lit("1"), raw_e)).otherwise(raw_e).try_cast("double").alias("evalue"),
        F.regexp_extract("hit", r"Identities\s*=\s*\d+/\d+\s*\((\d+)%\)", 1).try_cast("double").alias("identity"),
    )


def good_hits(hits: DataFrame, identity: tuple[float, float] = (30, 95), evalue: float = 1e-4, least: int = 11, share: float = 0.66) -> DataFrame:
    """Hits in the identity range, up to the e-value, over enough of the query."""
    span = F.col("query_end") - F.col("query_start") + 1
    return hits.filter(F.col("identity").between(*identity) & (F.col("evalue") <= evalue) & (span >= least) & (span >= share * F.col("query_length")))


def read_score_matrix(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """Letter-pair scores of a matrix file: comment lines (#), a line of letters, then a letter and its scores a line."""
    rows = spark.read.text(path).filter("trim(value) != '' and value not like '#%'").select(F.split(F.trim("value"), r"\s+").alias("cells"))
    table = [r[0] for r in rows.coalesce(1).collect()]  # one line per letter
    letters = table[0]
    return {(line[0], x): float(s) for line in table[1:] for x, s in zip(letters, line[1:], strict=True)}
