"""Registered queries of the thirteen text operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import laesa, langid, maxent, merkle, oracles, packing, partenum, repeats, rules, substrings, tiling, toxicity, wordpiece
from .common import fold, table
from .storage import Scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(4) == 2
    model = langid.fit(docs.filter(~held))
    out = langid.detect(docs, model, with_spans=False)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(10) == 0
    out = maxent.score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_words(table(spark, sf_dir, "documents"))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(3) == 1
    labelled = docs.select("doc_id", "text").filter(~held).join(Scratch(spark).beside(labels.select("doc_id", "toxic")), "doc_id")
    model = toxicity.fit(labelled)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = laesa.cluster(table(spark, sf_dir, "embeddings"))
    return out.withColumn("centroid_sha256", F.sha2(laesa.centroid_text(F.col("centroid")), 256)).drop("centroid")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(3) == 1
    labelled = docs.select("doc_id", "text").filter(~held).join(labels.select("doc_id", "quality"), "doc_id")
    out = rules.score(docs, rules.fit(labelled))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.when(fold(3) == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    record = lambda text: merkle.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    leaves = docs.select("doc_id", "lang", record(F.col("text")).alias("digest"), record(lowered).alias("tampered"))
    proofs = merkle.prove(leaves, "lang", "doc_id", "digest", ["tampered"])
    others = F.flatten(F.transform("proof", lambda step: F.array(step["left"], step["right"])))
    out = proofs.select("doc_id", *[merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(F.array_join(F.transform(others, merkle.as_text), ""), 256).alias("proof_sha256"), merkle.as_text(merkle.folded(F.col("tampered"), F.col("proof"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_repetition_rules": op8_repetition_rules,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
