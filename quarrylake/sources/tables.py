"""Table scans and sinks: chunks as JSON lines or Parquet, upserts on plain files, idempotent appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("pos", T.LongType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system Spark uses for the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_chunks(spark: SparkSession, path: str, documents: list[str] | None = None) -> DataFrame:
    """Chunks of some or all documents from JSON lines; a missing path has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], CHUNK)
    found = spark.read.schema(CHUNK).json(path, recursiveFileLookup=True).where("chunk_id IS NOT NULL")
    return found if documents is None else found.where(F.col("document_id").isin(documents))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per document; writing a document again replaces its folder only."""
    chunks.withColumn("document", F.col("document_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").json(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> str:
    """A new version of a table with rows replaced by key; returns its path (the old one is never overwritten while read)."""
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    kept = spark.read.parquet(path).join(rows.select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else spark.createDataFrame([], rows.schema)
    kept.unionByName(rows.dropDuplicates(keys), allowMissingColumns=True).write.parquet(target)
    return target


def appended(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet, each once: inserts that may be repeated."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def guarded_delete(rows: DataFrame, gone: DataFrame, used: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and the ids that were asked for but are in use."""
    asked = gone.select(key).distinct()
    skipped = asked.join(used.select(key).distinct(), key, "left_semi")
    return rows.join(asked.join(skipped, key, "left_anti"), key, "left_anti"), skipped
