"""Grouping of entity surfaces: containment, character n-gram similarity, connected components, communities."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T

GRAY, TOP_PAIRS, GROUP, ROUNDS = 0.42, 4, 60, 50


def shared_folder(spark) -> str:
    """The folder that the driver and all executors share; a temporary one only where all of Spark is one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Rows of whole texts in an Arrow batch (some 30 MB where every text has 120,000 characters).
TEXTS = 256


@contextlib.contextmanager
def arrow_rows(spark, rows: int | None) -> Iterator[None]:
    """While a table is made: at most so many rows in an Arrow batch, then as before; by default nothing changes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(before if rows is None else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Through the shared folder, so loops keep short plans and lost executors lose nothing.

    ``rows`` bounds the Arrow batches, so Python's memory is that of a batch at any size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts that a Python function over rows takes from an Arrow batch at a time.
SLICE = 64


def by_slices(frame: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows that ``rows_of`` makes of lists of a table's columns, a few rows at a time.

    A batch stays in Arrow's own form; Python objects are only those of ``SLICE`` rows, whatever the batch holds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                rows = list(rows_of(*[c.to_pylist() for c in batch.slice(a, SLICE).columns]))
                columns = zip(*rows, strict=True) if rows else [()] * len(made)
                columns = [[x and list(x.items()) for x in c] if pa.types.is_map(f.type) else list(c) for c, f in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return frame.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node of ``links(a, b)`` reaches (labels, then their labels)."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        step = written(low.join(up, "low").select("node", F.least("low", "up").alias("component"), "was"), "labels")
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def communities(links: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation for a fixed number of rounds: each node takes its neighbours' most frequent label.

    An approximation of modularity communities (ties: the smallest label), bounded in rounds.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both.b == labels.node).groupBy("a", "label").agg(F.count("*").alias("n"))
        labels = written(votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")), "labels")
    return labels


def contained(keys: DataFrame) -> DataFrame:
    """Pairs of ``keys(key)`` where all words of one are in the other, which has one more at most.

    Joined on words; as all words of the smaller match, its rarest word is enough to find it.
    """
    words = keys.select("key", F.array_distinct(F.split("key", " ")).alias("w")).withColumn("n", F.size("w"))
    spread = words.select("key", "n", F.explode("w").alias("word"))
    df = spread.groupBy("word").agg(F.count("*").alias("df"))
    rare = spread.join(df, "word").groupBy("key", "n").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    pairs = rare.select(F.col("key").alias("small"), F.col("n").alias("small_n"), "word").join(spread.select(F.col("key").alias("large"), F.col("n").alias("large_n"), "word"), "word")
    sized = pairs.where("small <> large AND large_n - small_n BETWEEN 0 AND 1")
    both = sized.join(words.select(F.col("key").alias("small"), F.col("w").alias("sw")), "small").join(words.select(F.col("key").alias("large"), F.col("w").alias("lw")), "large")
    return both.where(F.size(F.array_except("sw", "lw")) == 0).select("small", "large")


def gray_pairs(keys: DataFrame, threshold: float = GRAY) -> DataFrame:
    """Pairs of keys whose bags of character trigrams have a cosine at the threshold, by a join on trigrams."""
    bags = keys.select("key", F.explode(T.char_grams(F.col("key"))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("c"))
    norms = bags.groupBy("key").agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("norm"))
    unit = bags.join(norms, "key").select("key", "gram", "c", "norm")
    a, b = (unit.select("gram", F.col("key").alias(f"{s}_key"), F.col("c").alias(f"{s}_c"), F.col("norm").alias(f"{s}_norm")) for s in "ab")
    dots = a.join(b, "gram").where("a_key < b_key").groupBy("a_key", "b_key", "a_norm", "b_norm").agg(F.sum(F.col("a_c") * F.col("b_c")).alias("dot"))
    return dots.select("a_key", "b_key", F.round(F.col("dot") / (F.col("a_norm") * F.col("b_norm")), 6).alias("score")).where(F.col("score") >= threshold)


def top_pairs(pairs: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """Of each key its k best partners; a pair stays if either side picks it."""
    sides = pairs.select(F.col("a_key").alias("key"), F.col("b_key").alias("other"), "score").unionByName(pairs.select(F.col("b_key").alias("key"), F.col("a_key").alias("other"), "score"))
    best = sides.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("other")))).where(F.col("n") <= k)
    return best.select(F.least("key", "other").alias("a_key"), F.greatest("key", "other").alias("b_key"), "score").distinct()


def batches(members: DataFrame, order: str, size: int = GROUP) -> DataFrame:
    """Number members of each component in order and cut them into groups of a size."""
    n = F.row_number().over(Window.partitionBy("component").orderBy(order))
    return members.withColumn("part", F.floor((n - 1) / size).cast("long"))


def linked_entities(questions: DataFrame, entities: DataFrame, longest: int = 7, least: int = 3) -> DataFrame:
    """Entities ``(entity_id, key, priority)`` named in ``questions(query_id, text)`` by a run of words; the best two.

    Word windows up to the longest key meet the keys by an equi-join.
    """
    words = F.col("words")
    n = F.size(words)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(F.array_join(F.slice(words, i, k), " ").alias("key"), k.alias("n")))))
    asked = questions.where(F.trim("text") != "").select("query_id", F.split(T.graph_key(F.col("text")), " ").alias("words"))
    windows = asked.select("query_id", F.explode(F.array_distinct(grams)).alias("g")).select("query_id", "g.key", "g.n").where(F.length("key") >= least)
    found = windows.join(entities, "key")
    own = Window.partitionBy("query_id").orderBy("priority", F.desc("n"), "entity_id")
    return found.withColumn("rank", F.row_number().over(own)).where("rank <= 2").select("query_id", "entity_id", "key", "rank")


def consolidated_types(rows: DataFrame, order: list[str]) -> DataFrame:
    """Per canonical name: the first type of a fixed order that is there, else the most frequent."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    counted = rows.groupBy("canonical", "type").agg(F.count("*").alias("n")).withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(order) + 1)))
    return counted.groupBy("canonical").agg(F.min_by("type", F.struct("place", -F.col("n"), "type")).alias("type"))
