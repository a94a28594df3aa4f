"""A training-data pipeline over ``documents``: five stages, each one of the text operators.

Every stage takes all rows its predecessor kept and writes them to the shared folder; all but
the last return the columns of ``documents``. Later stages see the texts as earlier ones left them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_rri.llm import langid, packing, partenum, substrings, tiling
from spark_rri.llm.common import table
from spark_rri.llm.queries import tokenizer_path
from spark_rri.llm.storage import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned from ``lang``: it labels at least a quarter of the letters.

    Null, empty and letterless texts go, and texts in scripts of no learned language; without any
    ``lang`` all go. Repeated rows are judged alike; ids and other columns play no part.
    """
    model = langid.fit(docs)
    return langid.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, similarity of 0.8).

    Null, empty and blank texts are near to nothing and stay; of rows that repeat an id one stays;
    rows without an id stay. Columns may have any names.
    """
    return partenum.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte in a 200-byte string that also starts elsewhere; documents stay, ``n_chars`` follows.

    Null and short texts stay as they are; rows that repeat are two texts, so both lose what they
    share; a character that a cut breaks goes whole.
    """
    return substrings.without_repeated_bytes(docs, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, in whatever order of its parts.

    Null and empty texts and items match nothing; rows are judged each by its own text, whatever its id.
    """
    return tiling.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in the packed sequences; null and empty texts are one end id, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Learned languages, hashes of text windows and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
