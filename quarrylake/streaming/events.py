"""Structured Streaming: windows over events, exactly-once upserts, incremental deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators.dedup import text_key


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone (the session's)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def windowed(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; late rows are taken up to the delay."""
    source = _timed(events, delay)
    return source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than the gap apart."""
    source = _timed(events, delay)
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay: state is dropped as the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there now and return the table it filled, from files: each batch under its number.

    ``complete`` batches replace what came before (the last one is the table), others add to it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = stream.sparkSession.read.parquet(path)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def worked_off(stream: DataFrame, path: str, checkpoint: str, work, keys: list[str]) -> None:
    """A worker over a stream of tasks: each micro-batch is worked on and its results written under its number.

    Tasks whose result is there already are skipped, so a restart or a task sent twice does no work twice; the
    checkpoint remembers what was read.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        from quarrylake.sources.tables import exists

        fresh = batch.dropDuplicates(keys)
        if exists(spark, path):
            done = spark.read.parquet(path).where(F.col("batch") != number).select(*keys).distinct()
            fresh = fresh.join(done, keys, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended_traces(traces: DataFrame, path: str) -> None:
    """Trace records added to an append-only folder of JSON lines."""
    traces.write.mode("append").text(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> None:
    """Last-write-wins sink: every batch is written under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.col(order)).alias("row")).select(*keys, "row.*")
        last.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys and c != "batch"]), F.struct(F.col(order), F.col("batch"))).alias("row")).select(*keys, "row.*")


def new_texts(stream: DataFrame, text_col: str = "text", delay: str = "1 hour") -> DataFrame:
    """Chunks of a stream whose normalised text wasn't seen within the delay (needs a ``ts`` column)."""
    return first_seen(stream.withColumn("text_key", T.fingerprint(text_key(F.col(text_col)))), "text_key", delay)
