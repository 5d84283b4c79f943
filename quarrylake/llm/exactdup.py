"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

Pass one fills a blocked counting filter: a text's 64-bit hash names one word of ``CELLS`` counters of four
bits and two counters in it.  Rows are summed into words before anything is sent (a packed sum is the sum of
all counters at once), so a task sends each word it touched once, however many rows it has.  Words with more
than 15 rows, where a counter may have run over, count as repeated throughout.  What is kept is one bit a
counter: whether two rows or more fell in it.

Pass two probes these bits: a text with a counter of its own is certainly unique and goes straight through.
Only the possible repeats (narrow rows of id and digest) are shuffled and grouped by the SHA-256 of the whole
text.  A group with more than one in ``HOT`` of them is joined back by broadcast (fewer than ``HOT`` rows by
arithmetic), so no task gets a large group.

The filter has a word (two bytes of bits) a row and is broadcast in pages.  More than ``FILTER_BYTES`` of it
are probed range by range of words, in as many rounds, each over its own part of the rows; the bound on what
tasks receive and the share of unique rows that are shuffled for nothing (1.5 in 100 at a row a word, 0.4 at
half a row) are the same at every size.  With one round only they would be 1 in 100 at 10^8 rows and 14 in
100 at 10^9.

Defined cases: a null text equals the empty text; ids may be null or repeated (``keep_id`` is the largest
non-null id; of rows that repeat it one is kept); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, whole_text

CELLS = 16
#: Longs of a page (16 words' bits each four), bytes of filter probed in one round, and the share of a large group.
PAGE, FILTER_BYTES, HOT = 1024, 1 << 29, 2000
_LOW = 0x1111111111111111  # the lowest bit of each counter


def filter_words(rows: int) -> int:
    """Words of the filter: a power of two, at least one a row."""
    return 1 << max(12, (rows - 1).bit_length() if rows > 1 else 0)


def _word(words: int) -> Column:
    return F.col("fingerprint").bitwiseAND(words - 1)


def _cells() -> list[Column]:
    """The two counters of a hash in its word, from bits that don't name the word."""
    return [F.shiftrightunsigned("fingerprint", shift).bitwiseAND(CELLS - 1).cast("int") for shift in (56, 60)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def repeated_counters(rows: DataFrame, words: int) -> DataFrame:
    """``slot, set``: four words' bits to a long; bit ``4 * cell + word % 4`` says that two rows or more are in that counter."""
    one, two = _cells()
    adds = _bit(one * 4) + F.when(one != two, _bit(two * 4)).otherwise(F.lit(0).cast("long"))
    sums = rows.select(_word(words).alias("word"), adds.alias("adds")).groupBy("word").agg(F.count("*").alias("n"), F.try_sum("adds").alias("sum"))
    several = F.shiftrightunsigned("sum", 1).bitwiseOR(F.shiftrightunsigned("sum", 2)).bitwiseOR(F.shiftrightunsigned("sum", 3)).bitwiseAND(F.lit(_LOW))
    flags = F.when((F.col("n") < CELLS) & F.col("sum").isNotNull(), several).otherwise(F.lit(_LOW))
    marked = sums.select("word", flags.alias("flags")).where("flags <> 0")
    return marked.groupBy(F.shiftright("word", 2).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.col("flags"), (F.col("word") % 4).cast("int"))).alias("set"))


def pages(counters: DataFrame, words: int) -> DataFrame:
    """``page, part``: the slots of each page in order."""
    every = counters.sparkSession.range(words // 4).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("set"))
    filled = counters.unionByName(every).groupBy("slot").agg(F.bit_or("set").alias("set"))
    place = F.struct(F.col("slot").bitwiseAND(PAGE - 1).alias("place"), "set")
    return filled.groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["set"]).alias("part"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words = filter_words(docs.select(id_col).count())
    rounds = max(1, 2 * words // max(filter_bytes, 2 * 4 * PAGE))
    text = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    narrow = text.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("fingerprint"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = scratch.keep(narrow.withColumn("turn", F.floor(_word(words) / (words // rounds))), "digests", by="turn" if rounds > 1 else None)
    table = scratch.keep(pages(repeated_counters(rows, words), words), "repeat-filter")
    slot = F.shiftright(_word(words), 2)
    value = F.element_at("part", (slot.bitwiseAND(PAGE - 1) + 1).cast("int"))
    probed_path = fresh_path(spark, "probed")
    per_round = words // 4 // PAGE // rounds or 1
    for turn in range(rounds):
        own = rows.where(F.col("turn") == turn).withColumn("page", F.floor(slot / PAGE))
        held = table.where((F.col("page") >= turn * per_round) & (F.col("page") < (turn + 1) * per_round))
        shared = None
        for cell in _cells():
            hit = F.shiftrightunsigned(value, 0).bitwiseAND(_bit(cell * 4 + (_word(words) % 4).cast("int"))) != 0
            shared = hit if shared is None else shared & hit
        # filter_bytes of pages at most
        own.join(F.broadcast(held), "page").select("doc_id", "row", "digest", shared.alias("maybe")).write.mode("append").parquet(probed_path)
    probed = spark.read.schema("doc_id " + narrow.schema["doc_id"].dataType.simpleString() + ", row long, digest binary, maybe boolean").parquet(probed_path)
    maybe = probed.where("maybe").select("doc_id", "row", "digest")
    groups = scratch.keep(maybe.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") * HOT > total)
    cold = maybe.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.where(F.col("group_size") * HOT <= total), "digest")
    repeated = cold.unionByName(maybe.join(F.broadcast(hot), "digest")).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "digest")
    unique = probed.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    scratch.drop(rows, table)
    return unique.unionByName(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
