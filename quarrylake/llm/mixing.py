"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a target stops
at ``REPEATS`` times its source's size and the excess goes to the others by weight.  That is the water
level ``max over j of (total - capped before j) / weight from j on`` with sources in order of cap over weight.

Order: within a source, documents are shuffled by the MD5 of their id and laid end to end, again and again
up to the target; that stream is cut into blocks of ``ceil(total / SLOTS)`` words (the last may be shorter).

Schedule: slot t takes the point ``frac((t + 1/2) * golden ratio)``, which falls in the cumulative quotas
of blocks into one source; the slot's rank among those of its source names the block.  Slots beyond a
source's quota stay empty, and blocks that no slot has reached follow at the end, a few to a source.  So any
prefix of the slots holds every source in nearly its share.  Each document carries its parts (slot, first
word, words), and :func:`mixed_texts` gives the texts of the parts in the order of their slots.

Offsets within a source are running sums in two levels (over ranges of the hash, as many as the source has
rows for, then within one), so no task needs a whole source.  Per-source totals and the schedule (``SLOTS``
rows and one for each source) are small tables; they are broadcast only after a count.

Defined cases: a null text has no words; empty documents take nothing; a null source is a source; null ids
hash like the empty text; rows that repeat an id are placed one after the other; an empty table gives
no rows; further columns are ignored, or carried by :func:`mixed_texts` under any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import Scratch, arrow_rows, bounded, materialize, whole_text

#: Slots, times that a document is taken at most, rows of a range of the hash, hexadecimal digits that ranges differ in at most.
SLOTS, REPEATS, BUCKET_ROWS, DIGITS = 1 << 16, 3, 256, 5
GOLDEN = 0.6180339887498949
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """From ``none, source, size`` of each source: also ``idx, weight, target, quota`` (words to take)."""
    ordered = Window.orderBy("none", "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    known = sizes.withColumn("idx", F.row_number().over(ordered) - 1).withColumn("weight", 1 + F.col("idx") % 3).withColumn("cap", REPEATS * F.col("size"))
    total = F.sum("size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = known.withColumn("total", total).withColumn("level", (total - before) / weight)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(Window.partitionBy()) * F.col("weight"))
    return level.withColumn("target", target).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")).drop("level", "cap")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``slot, idx, rank``: which block of which source comes when."""
    blocks = sources.select("idx", F.ceil(F.col("quota") / block).cast("long").alias("n")).where("n > 0")
    cum = blocks.withColumn("until", F.sum("n").over(Window.orderBy("idx")))
    cells = cum.select("idx", "n", F.explode(F.sequence(F.col("until") - F.col("n"), F.col("until") - 1)).alias("cell"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    points = sources.sparkSession.range(n).select(F.col("id").alias("slot"), F.least(F.floor(((F.col("id") + 0.5) * GOLDEN) % 1 * n), F.lit(n - 1)).cast("long").alias("cell"))
    drawn = points.join(cells, "cell").withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy("slot")).cast("long") - 1).where("rank < n").select("slot", "idx", "rank")
    reached = drawn.groupBy("idx").agg(F.count("*").alias("got"))
    left = blocks.join(reached, "idx", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < n").select("idx", F.explode(F.sequence("got", F.col("n") - 1)).alias("rank"))
    tail = left.select((F.row_number().over(Window.orderBy("rank", "idx")) - 1 + n).cast("long").alias("slot"), "idx", "rank")
    return drawn.unionByName(tail)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: str = "CAST(NULL AS LONG)") -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the sources."""
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.expr(row).alias("row"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.regexp_count(whole_text(text_col), F.lit(WORDS)).cast("long").alias("size")),
        "sizes",
    )
    totals = sized.groupBy("none", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    digits = F.greatest(F.lit(1), F.least(F.lit(DIGITS), F.ceil(F.log2(F.col("rows") / BUCKET_ROWS) / 4))).cast("int")
    sources = materialize(targets(totals).withColumn("digits", digits), "sources")
    n = sources.count()
    named = sized.join(bounded(sources.select("none", "source", "idx", "digits", F.col("size").alias("source_size"), "target", "quota"), n, 200_000), ["none", "source"])
    keyed = named.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.expr("substring(turn, 1, digits)"))
    own = Window.partitionBy("idx", "bucket").orderBy("turn", "doc_id", "size")
    local = keyed.withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("pos", F.row_number().over(own))
    buckets = keyed.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    # At most 16 ** DIGITS rows of a source in one task.
    base = buckets.select("idx", "bucket", (F.sum("n").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("n")).alias("base"))
    return local.join(base, ["idx", "bucket"]).withColumn("start", F.col("base") + F.col("before")).drop("before", "base", "turn", "none", "digits"), sources


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, row: str = "CAST(NULL AS LONG)") -> DataFrame:
    """The mix: one row for each part of a document in a slot, and one with a null slot for documents not taken.

    Columns: ``slot``, the document's ``doc_id, row, idx, bucket, pos, source, size, source_size, target``, and
    ``from_word, words`` of the part.
    """
    rows, sources = placed(docs, id_col, text_col, source_col, row)
    total = sources.agg(F.sum("size"), F.count("*")).first()
    block = max(1, -(-(total[0] or 0) // slots))
    plan = materialize(schedule(sources, block), "schedule")
    rounds = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda k: F.struct((F.col("start") + k * F.col("source_size")).alias("a"), F.least(F.col("start") + k * F.col("source_size") + F.col("size"), F.col("quota")).alias("b")))
    spans = F.filter(rounds, lambda x: x["a"] < x["b"])
    parts = F.flatten(F.transform(spans, lambda x: F.transform(F.sequence(F.floor(x["a"] / block), F.floor((x["b"] - 1) / block)), lambda r: F.struct(r.alias("rank"), (F.greatest(x["a"], r * block) - x["a"]).alias("from_word"), (F.least(x["b"], (r + 1) * block) - F.greatest(x["a"], r * block)).alias("words")))))
    pieces = rows.withColumn("part", F.explode_outer(parts)).select("doc_id", "row", "idx", "bucket", "pos", "source", "size", "source_size", "target", F.col("part.rank").cast("long").alias("rank"), F.col("part.from_word"), F.col("part.words"))
    return pieces.join(bounded(plan, slots + total[1], 1_000_000), ["idx", "rank"], "left").drop("rank")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, parts`` (slot:from_word:words by slot, comma-joined)."""
    parts = mixed(docs, id_col, text_col, source_col, slots)
    part = F.when(F.col("slot").isNotNull(), F.struct("slot", "from_word", "words"))
    listed = parts.groupBy("idx", "bucket", "pos", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(part.isNotNull(), F.col("words")).otherwise(0)).alias("taken"), F.sort_array(F.collect_list(part)).alias("own"))
    return listed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("own", lambda x: F.concat_ws(":", x["slot"], x["from_word"], x["words"])), ",").alias("parts"))


def _cut(text: str | None, own: list[dict]) -> list[str]:
    """The parts of a text, each from its first word to the next part's first (the last to the text's end)."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = kernel.word_spans(data, np.array([0, len(data)]), kernel.SPACED)
    starts = np.append(starts, len(data))
    starts[0] = 0
    return [data[starts[p["from_word"]] : starts[min(p["from_word"] + p["words"], len(ends))]].tobytes().decode() for p in own]


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """The mix as rows of the input's columns, one for each part with its text, in the order of slots.

    The order is that of partitions and of the rows in each; written files keep it (:func:`tokenfiles.file_order`).
    """
    spark, scratch, columns = docs.sparkSession, Scratch(docs.sparkSession), docs.columns
    # The columns go in a struct, so that their names can't clash.
    held = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "to-mix")
    plain = held.select("row", *[F.col("doc").getField(c).alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))])
    parts = mixed(plain, slots=slots, row="row").where("slot IS NOT NULL")
    lists = scratch.keep(parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "from_word", "words"))).alias("own")), "parts")
    placed_docs = held.join(bounded(lists, lists.count(), 500_000), "row")

    @kernel.tidy
    def cut(batches):
        for batch in batches:
            own, doc = batch.column(0).to_pylist(), batch.column(1)
            index = np.repeat(np.arange(batch.num_rows), [len(x) for x in own])
            at = doc.type.get_field_index(text_col)
            texts = [t for x, text in zip(own, doc.field(at), strict=True) for t in _cut(text.as_py(), x)]
            fields = [pa.array(texts, doc.type.field(at).type) if k == at else doc.field(k).take(pa.array(index)) for k in range(doc.type.num_fields)]
            slot = pa.array([p["slot"] for x in own for p in x], pa.int64())
            yield pa.RecordBatch.from_arrays([slot, pa.array([p["from_word"] for x in own for p in x], pa.int64()), pa.StructArray.from_arrays(fields, fields=list(doc.type))], names=["slot", "from_word", "doc"])

    kind = held.schema["doc"].dataType.simpleString()
    with arrow_rows(spark, 500):
        texts = scratch.keep(placed_docs.select("own", "doc").mapInArrow(cut, f"slot long, from_word long, doc {kind}"), "mixed")
    size = docs.sparkSession.sparkContext.defaultParallelism
    count = texts.select("slot").count()
    ordered = texts.repartitionByRange(max(size, count // 10_000), "slot", "from_word").sortWithinPartitions("slot", "from_word")
    scratch.drop(held, lists)
    return ordered.select(*[F.col("doc").getField(c).alias(c) for c in columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT none, source, row_number() OVER (ORDER BY none, source) - 1 AS idx, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY none, source),
caps AS (SELECT *, 1 + idx % 3 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (CAST((SELECT sum(size) FROM sized) AS BIGINT)
      - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
      / CAST(sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM caps),
aims AS (SELECT none, source, idx, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target FROM levels),
quotas AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM aims),
placed AS (
  SELECT row_number() OVER () AS row, doc_id, idx, size, source_size, target, quota,
         CAST(sum(size) OVER (PARTITION BY idx ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM sized JOIN quotas USING (none, source)),
sizes AS (SELECT greatest(1, CAST(ceil(sum(size) / 65536) AS BIGINT)) AS block FROM sized),
blocks AS (
  SELECT idx, CAST(ceil(quota / (SELECT block FROM sizes)) AS BIGINT) AS n FROM quotas WHERE quota > 0),
edges AS (SELECT idx, n, CAST(sum(n) OVER (ORDER BY idx) AS BIGINT) AS until FROM blocks),
total AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM blocks),
points AS (
  SELECT slot, least(CAST(floor(((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1::DOUBLE * total.n) AS BIGINT), total.n - 1) AS cell
  FROM total, unnest(range(total.n)) AS t(slot)),
drawn AS (
  SELECT slot, idx, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank, edges.n
  FROM points JOIN edges ON cell >= until - edges.n AND cell < until),
reached AS (SELECT idx, count(*) AS got FROM drawn WHERE rank < n GROUP BY idx),
tails AS (
  SELECT idx, unnest(range(coalesce(got, 0), n)) AS rank FROM blocks LEFT JOIN reached USING (idx)),
plan AS (
  SELECT slot, idx, rank FROM drawn WHERE rank < n
  UNION ALL SELECT row_number() OVER (ORDER BY rank, idx) - 1 + (SELECT n FROM total), idx, rank FROM tails),
spans AS (
  SELECT row, idx, start + k * source_size AS a, least(start + k * source_size + size, quota) AS b FROM placed, unnest([0, 1, 2]) AS t(k)),
cut AS (
  SELECT row, idx, a, b, unnest(range(a // block, (b - 1) // block + 1)) AS rank, block FROM spans, sizes WHERE a < b),
parts AS (
  SELECT row, string_agg(slot || ':' || (greatest(a, rank * block) - a) || ':' || (least(b, (rank + 1) * block) - greatest(a, rank * block)), ',' ORDER BY slot, greatest(a, rank * block) - a) AS parts,
         CAST(sum(least(b, (rank + 1) * block) - greatest(a, rank * block)) AS BIGINT) AS taken
  FROM cut JOIN plan USING (idx, rank) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(parts, '') AS parts
FROM placed LEFT JOIN parts USING (row)
"""
