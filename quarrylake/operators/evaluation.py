"""Evaluation warehouse: retrieval metrics, run comparison, progress, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.operators.cluster import written


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the listed truth ids among the first k (repeated truth ids lower it); no truth gives 0."""
    hit = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(hit / F.size(relevant))


def ground_truth_rank(retrieved: Column, relevant: Column) -> Column:
    """First position (from 1) of any truth id, or null."""
    at = F.transform(relevant, lambda x: F.nullif(F.array_position(retrieved, x), F.lit(0).cast("long")))
    return F.array_min(at)


def reciprocal_rank(retrieved: Column, relevant: Column, k: int) -> Column:
    rank = ground_truth_rank(F.slice(retrieved, 1, k), relevant)
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def covered(retrieved: Column, relevant: Column, k: int) -> Column:
    """1 if all truth ids are among the first k."""
    return F.when((F.size(relevant) > 0) & (F.size(F.array_except(relevant, F.slice(retrieved, 1, k))) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


def citation_overlap(cited: Column, relevant: Column) -> Column:
    """Share of the truth that is cited."""
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(cited, relevant)) / F.size(relevant))


def any_citation(cited: Column, relevant: Column) -> Column:
    return F.arrays_overlap(cited, relevant)


def metrics(answers: DataFrame, k: int = 5) -> DataFrame:
    """From ``question_id, retrieved, relevant``: recall, reciprocal rank, rank and coverage."""
    r, t = F.col("retrieved"), F.col("relevant")
    return answers.select("question_id", F.round(recall_at_k(r, t, k), 6).alias("recall"), F.round(reciprocal_rank(r, t, k), 6).alias("rr"), ground_truth_rank(r, t).alias("truth_rank"), covered(r, t, k).alias("coverage"))


def averages(results: DataFrame, keys: list[str], scores: list[str], passed: str) -> DataFrame:
    """Counts and mean scores of runs; a missing pass counts as not passed."""
    return results.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in scores], F.round(F.avg(F.when(F.col(passed), 1.0).otherwise(0.0)), 6).alias("pass_rate"))


def progress(runs: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """Done, failed and remaining of each run, with runs that have no result yet."""
    done = results.groupBy(run).agg(F.count("*").alias("done"), F.count_if("failed").alias("failed"))
    return runs.join(done, run, "left").select(run, "total", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), (F.col("total") - F.coalesce("done", F.lit(0))).alias("left"))


def inherited(results: DataFrame, run: str, own: DataFrame, key: str) -> DataFrame:
    """Other runs that cover at least half of a set of questions."""
    total = own.count()
    return results.join(own.select(key).distinct(), key, "left_semi").groupBy(run).agg(F.count_distinct(key).alias("covered")).where(F.col("covered") * 2 >= total).withColumn("total", F.lit(total))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Shared and one-sided keys, and the share of the left that the right has."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only")).withColumn("match_pct", F.round(100.0 * F.col("shared") / (F.col("shared") + F.col("left_only")), 4))


def stratified(rows: DataFrame, stratum: str, order: str, quota: int, total: int) -> DataFrame:
    """The first rows of each stratum up to a quota, then others in order until the total."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    picked = ranked.withColumn("_spare", (F.col("_n") > quota).cast("int")).orderBy("_spare", order).limit(total)
    return picked.select(*rows.columns, (F.col("_spare") == 1).alias("backfill"))


def sequence(rows: DataFrame, *order: Column, name: str = "seq") -> DataFrame:
    """Global numbers by an order, without sending all rows to one task: counts of ranges, then numbers within.

    The ranges are written first, as a sort that ran twice could deal its ranges otherwise.
    """
    ranges = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = written(ranges, "ranges")
    counts = placed.groupBy("_part").count()  # a row a partition
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return placed.join(before, "_part").withColumn(name, within + F.col("_before") + 1).drop("_part", "_at", "_before")
