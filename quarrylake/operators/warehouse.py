"""Evaluation warehouse as tables in, tables out: questions, approvals, datasets, runs and results.

Tables: ``questions(question_id, question, ground_truth, source_chunk_ids, section, document_id, created_at,
deleted_at)``, ``approvals(question_id, reviewer, approved_at)``, ``members(dataset_id, question_id)``,
``datasets(dataset_id, name, created_at)``, ``runs(run_id, dataset_id, status, question_ids, created_at)`` and
``results(question_id, run_id, error, score, response, ran_at)``.  Operators return the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added, or in the place of those with their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def approved(approvals: DataFrame, question_ids: DataFrame, reviewer: str, at: Column) -> DataFrame:
    rows = question_ids.select("question_id").distinct().select("question_id", F.lit(reviewer).alias("reviewer"), at.alias("approved_at"))
    return _put(approvals, rows, ["question_id"])


def added_if_approved(members: DataFrame, approvals: DataFrame, dataset_id, question_ids: DataFrame) -> DataFrame:
    """Approved questions that the dataset doesn't have yet are added; anything else changes nothing."""
    rows = question_ids.select("question_id").distinct().join(approvals.select("question_id"), "question_id", "left_semi").select(F.lit(dataset_id).alias("dataset_id"), "question_id")
    return members.unionByName(rows.join(members, ["dataset_id", "question_id"], "left_anti"))


def archived(questions: DataFrame, question_ids: DataFrame, at: Column) -> DataFrame:
    """Soft delete: those questions get a time, or keep theirs."""
    return _marked(questions, question_ids, F.coalesce("deleted_at", at))


def restored(questions: DataFrame, question_ids: DataFrame) -> DataFrame:
    return _marked(questions, question_ids, F.lit(None).cast("timestamp"))


def _marked(questions: DataFrame, question_ids: DataFrame, value: Column) -> DataFrame:
    asked = question_ids.select("question_id").distinct().withColumn("asked", F.lit(True))
    return questions.join(asked, "question_id", "left").withColumn("deleted_at", F.when(F.col("asked"), value).otherwise(F.col("deleted_at"))).select(*questions.columns)


def without_dataset(dataset_id, datasets: DataFrame, members: DataFrame, runs: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """A dataset goes with its runs, their results and its memberships; its questions stay."""
    own = runs.where(F.col("dataset_id") == dataset_id).select("run_id")
    keep = ~F.coalesce(F.col("dataset_id") == dataset_id, F.lit(False))
    return {"results": results.join(own, "run_id", "left_anti"), "runs": runs.where(keep), "members": members.where(keep), "datasets": datasets.where(keep)}


def inserted(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """New questions appended; ids that are there stay as they are."""
    return questions.unionByName(rows.dropDuplicates(["question_id"]).join(questions.select("question_id"), "question_id", "left_anti"), allowMissingColumns=True)


def with_results(results: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results by (question, run), the last written wins; and how many truly new ones each run has, by success."""
    keys = ["question_id", "run_id"]
    rest = [c for c in results.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ran_at").alias("r")).select(*keys, "r.*")
    fresh = last.join(results.select(*keys), keys, "left_anti")
    counts = fresh.groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return _put(results, last, keys), counts


def question_table(questions: DataFrame, approvals: DataFrame, members: DataFrame) -> DataFrame:
    """Live questions with their number (newest first), reviewer, whether approved, and in how many datasets."""
    live = questions.where("deleted_at IS NULL")
    order = Window.orderBy(F.desc_nulls_last("created_at"), "question_id")
    uses = members.groupBy("question_id").agg(F.count("*").alias("datasets"))
    return live.withColumn("number", F.row_number().over(order)).join(approvals, "question_id", "left").join(uses, "question_id", "left").select("question_id", "number", "reviewer", F.col("approved_at").isNotNull().alias("approved"), F.coalesce("datasets", F.lit(0)).alias("datasets"))


def run_history(results: DataFrame, runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Results with their run and dataset, latest first."""
    named = results.join(runs.select("run_id", "dataset_id", "status"), "run_id").join(datasets.select("dataset_id", "name"), "dataset_id", "left")
    return named.orderBy(F.desc_nulls_last("ran_at"), "run_id", "question_id")


def affected(questions: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Ids of questions with a source chunk among duplicates ``(chunk_id)``."""
    return questions.select("question_id", F.explode("source_chunk_ids").alias("chunk_id")).join(duplicates.select("chunk_id").distinct(), "chunk_id", "left_semi").select("question_id").distinct()


def dataset_preview(members: DataFrame, questions: DataFrame, approvals: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Of each dataset's approved live questions: how many, how many duplicates touch, how many remain."""
    live = members.join(questions.where("deleted_at IS NULL"), "question_id").join(approvals.select("question_id"), "question_id", "left_semi")
    hit = affected(questions, duplicates).withColumn("hit", F.lit(1))
    counts = live.join(hit, "question_id", "left").groupBy("dataset_id").agg(F.count("*").alias("total"), F.count("hit").alias("affected"))
    return counts.withColumn("remaining", F.col("total") - F.col("affected"))


def pending(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``run_id, question_id, place`` of the frozen questions of runs that have no result yet."""
    frozen = runs.select("run_id", F.posexplode("question_ids").alias("place", "question_id"))
    return frozen.join(results.select("run_id", "question_id"), ["run_id", "question_id"], "left_anti")


def next_pending(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The first pending question of each run."""
    return pending(runs, results).groupBy("run_id").agg(F.min_by("question_id", "place").alias("question_id"))


def failed(results: DataFrame, questions: DataFrame, runs: DataFrame) -> DataFrame:
    return results.where("error IS NOT NULL").join(questions.select("question_id", "question"), "question_id").join(runs.select("run_id", "status"), "run_id")


def scoring_batch(results: DataFrame, questions: DataFrame, size: int, ids: DataFrame | None = None) -> DataFrame:
    """Results still to be scored, oldest first: without error or score, and answered unless asked for by id."""
    open_ = results.where("error IS NULL AND score IS NULL")
    open_ = open_.where("response IS NOT NULL") if ids is None else open_.join(ids.select("question_id").distinct(), "question_id", "left_semi")
    return open_.join(questions.select("question_id", "question", "ground_truth"), "question_id").orderBy("ran_at", "question_id").limit(size)


def question_counts(questions: DataFrame, approvals: DataFrame, *keys: str) -> DataFrame:
    """Live questions by document or section: all, and approved ones."""
    live = questions.where("deleted_at IS NULL").join(approvals.select("question_id", "approved_at"), "question_id", "left")
    return live.groupBy(*keys).agg(F.count("*").alias("questions"), F.count("approved_at").alias("approved"))


def sections(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Sections of documents by name with their chunks and questions; unnamed ones take the title, or ``General``."""
    name = F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.lit("General"))
    held = chunks.groupBy("document_id", name.alias("section")).agg(F.count("*").alias("chunks"))
    asked = questions.where("deleted_at IS NULL").groupBy("document_id", "section").agg(F.count("*").alias("questions"))
    return held.join(asked, ["document_id", "section"], "left").withColumn("questions", F.coalesce("questions", F.lit(0))).orderBy("document_id", "section")


def compared(runs: DataFrame, results: DataFrame, dataset_id, own: DataFrame) -> DataFrame:
    """A dataset's own runs, and others' that have results for at least half of its questions, as one table."""
    means = lambda df: df.groupBy("run_id").agg(F.count("question_id").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.bool_or(F.col("error").isNotNull()).alias("any_error"))
    mine = runs.where(F.col("dataset_id") == dataset_id).select("run_id")
    native = means(mine.join(results, "run_id", "left")).withColumn("inherited", F.lit(False))
    total = own.select("question_id").distinct().count()
    others = results.join(mine, "run_id", "left_anti").join(own.select("question_id").distinct(), "question_id", "left_semi")
    lent = means(others).where(F.col("n") * 2 >= total).withColumn("inherited", F.lit(True))
    return native.unionByName(lent)


def listing(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("created_at"), "run_id").offset(max(0, offset)).limit(limit)


def slim(rows: DataFrame, heavy: list[str]) -> DataFrame:
    """Heavy columns as nulls: nothing of them is read."""
    return rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c in heavy else F.col(c) for c in rows.columns])


def json_array_counts(rows: DataFrame, column: str, least: int) -> DataFrame:
    """How many rows have each text of a JSON array, above a number; most first."""
    items = rows.select(F.explode(F.from_json(column, "array<string>")).alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "item")


def renumbered(rows: DataFrame, gone: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows without some keys, named Q1, Q2, ... in order."""
    from quarrylake.operators.evaluation import sequence

    left = rows.join(gone.select(key).distinct(), key, "left_anti")
    return sequence(left, F.col(pos), name="_n").withColumn("new_id", F.concat(F.lit("Q"), F.col("_n").cast("string"))).drop("_n")


def enqueued(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows ``(key, at)`` appended to a first-in-first-out queue; keys that wait or run are skipped."""
    busy = queue.where(F.col("status").isin("pending", "running")).select("key")
    return queue.unionByName(rows.dropDuplicates(["key"]).join(busy, "key", "left_anti").select("key", "at", F.lit("pending").alias("status")))


def taken(queue: DataFrame) -> DataFrame:
    """The queue with its first pending row running."""
    first = queue.where("status = 'pending'").orderBy("at", "key").limit(1).select("key", "at").withColumn("first", F.lit(True))
    return queue.join(first, ["key", "at"], "left").withColumn("status", F.when(F.col("first") & (F.col("status") == "pending"), "running").otherwise(F.col("status"))).select("key", "at", "status")


def recovered(queue: DataFrame) -> DataFrame:
    """After a restart: what was running waits again."""
    return queue.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def reinserted(rows: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """Rows in the order of the digits of their keys, with a restored one in its place."""
    digits = F.regexp_extract(key, r"(\d+)", 1).try_cast("int")
    return rows.unionByName(row.join(rows.select(key), key, "left_anti")).orderBy(digits, key)


def keyword_stats(rows: DataFrame, kind: str, words: str, top: int = 3) -> DataFrame:
    """By document type (nulls too): rows, mean number of keywords, the most frequent keywords."""
    base = rows.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.coalesce(words, F.array().cast("array<string>")))), 4).alias("avg_words"))
    counted = rows.select(F.col(kind).alias("k"), F.explode(words).alias("w")).groupBy("k", "w").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("c"), "w"))
    best = counted.withColumn("place", place).where(F.col("place") <= top).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), ",").alias("top"))
    return base.join(best, F.col(kind).eqNullSafe(F.col("k")), "left").drop("k")


def variant_rollup(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per canonical name of ``mapping(variant, canonical)``: rows, spellings with their counts, whether more than one is used."""
    counted = raw.groupBy("variant").agg(F.count("*").alias("n")).join(mapping, "variant", "left").withColumn("canonical", F.coalesce("canonical", "variant"))
    return counted.groupBy("canonical").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("variant", "n"))).alias("variants")).withColumn("inconsistent", F.size("variants") > 1)


def size_buckets(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2-5, 6-20, 21 or more rows."""
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")
    return rows.groupBy(key).agg(F.count("*").alias("n")).groupBy(bucket.alias("size")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def coverage(canonicals: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many chunks name each canonical entity; 0 for those that none names."""
    counts = chunks.select(F.explode(F.array_distinct("entities")).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("chunks"))
    return canonicals.join(counts, "canonical", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def capped(chunks: DataFrame, most: int) -> DataFrame:
    """The first chunks by document and place, up to a number."""
    return chunks.orderBy("document_id", "chunk_index", "chunk_id").limit(most)


def best_runs(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Of each group the run with the best score (ties: the smaller id)."""
    return rows.groupBy(group).agg(F.min_by("run_id", F.struct(-F.col(score), F.col("run_id"))).alias("run_id"), F.max(score).alias(score))
