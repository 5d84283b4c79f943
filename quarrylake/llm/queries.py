"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontam, exactdup, langid, mixing, neardup, ordinal, secrets, tokenfiles, toxicity
from .common import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfiles.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(langid.fold() != 2))
    found = langid.identify(docs, dictionaries)
    return found.withColumn("held_out", langid.fold() == 2).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    net = toxicity.learn(docs, labels.where(langid.fold(n=3) != 1))
    return toxicity.score(docs, net).withColumn("held_out", langid.fold(n=3) == 1).select("doc_id", "held_out", "score", "predicted")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (good but toxic) and 2 (good), learned from two thirds of the labelled rows."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    graded = labels.where("quality IN (0, 1)").withColumn("grade", F.expr("CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"))
    model = ordinal.learn(docs, graded.where(langid.fold(n=3) != 1))
    found = ordinal.grade(docs, model)
    return found.withColumn("held_out", langid.fold(n=3) == 1).select("doc_id", "held_out", "expected_grade", "tail_prob", "grade")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.archived(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_token_files": op2_token_files,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_source_mixing": op7_source_mixing,
        "op8_quality_grades": op8_quality_grades,
        "op9_warc": op9_warc,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": mixing.SQL, "op9_warc": archives.SQL, "op10_exact_dedup": exactdup.SQL}
