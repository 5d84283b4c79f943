"""Corpus pipeline: from raw documents to token files.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept, and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``; the last returns one row per written document, as read from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import decontam, langid, mixing, neardup, queries, tokenfiles
from quarrylake.llm.common import materialize, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; those without letters or between two languages go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8): the smallest id."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: the parts of documents in the order of their slots (a document up to three times, or not at all)."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: in the order of the rows in the files, or else of their ids."""
    found = tokenfiles.token_files(docs, queries.tokenizer_path(), order=tokenfiles.file_order(docs))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Compression, sketches, winnowing and byte-pair encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
