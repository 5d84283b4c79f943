"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z folded) and of characters outside ASCII.  A benchmark
window is ``WINDOW`` consecutive words of an item; an item with fewer words, but not none, is one window.
A document word inside any occurrence of a window is hit.

Both sides keep the minimum hash of each run of ``WINDOW - GRAM + 1`` consecutive ``GRAM``-grams
(winnowing), so a shared run of ``WINDOW`` words always has a kept gram in common.  The document's kept
grams are joined with those of the benchmark; around each match the windows that hold it are looked up
among the benchmark's, which extends a match to the whole shared span, and compared word by word in their
bytes.  Items too short for that are looked up by all their words directly.

The benchmark is dealt into blocks of about ``INDEX_WORDS`` words (long items are cut, overlapping by all but
one word of a window), and a block's index (about 60 bytes a word) is broadcast.  A larger benchmark takes one pass over the
documents for each block; only hits leave a pass, and a document's are merged by position.

Defined cases: null texts have no words; null items have no windows; items with a null id count as one item
with an empty name; null ids of documents are kept as they are; an empty benchmark hits nothing; repeated
rows are judged each by itself; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Scratch, bounded

WINDOW, GRAM = 10, 5
#: Words of benchmark text whose index is broadcast at once, and of a piece of an item.
INDEX_WORDS, PIECE_WORDS = 1_000_000, 10_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def kept_grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps, over texts laid end to end."""
    grams, span = kernel.gram_hashes(words, GRAM), WINDOW - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = grams[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, span):
        lower = grams[k : k + n] <= least  # of equal hashes the last is kept
        np.minimum(least, grams[k : k + n], out=least)
        at[lower] = k
    inside = np.zeros(n, dtype=bool)  # windows that stay in one text
    lengths = np.diff(first)
    for a, size in zip(first[:-1][lengths >= WINDOW], lengths[lengths >= WINDOW], strict=True):
        inside[a : a + size - WINDOW + 1] = True
    positions = np.unique((np.arange(n) + at)[inside])
    return positions, grams[positions]


class Index:
    """Windows of some benchmark items: sorted hashes of windows and kept grams, and whose each window is and where it stands."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        data, offsets = kernel.string_buffers(pa.array([text or "" for _, text in items], pa.large_string()))
        self.padded = np.append(kernel.ALNUM.letter[data], np.zeros(8, np.uint8))
        self.starts, self.ends, first = kernel.word_spans(data, offsets, kernel.ALNUM)
        words = kernel.span_hashes(data, self.starts, self.ends, kernel.ALNUM)
        by_length: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                hashes = kernel.gram_hashes(words[a:b], min(WINDOW, b - a))
                by_length.setdefault(min(WINDOW, b - a), []).append((hashes, np.full(len(hashes), row, np.int32), np.arange(a, a + len(hashes))))
        self.grams = np.unique(kept_grams(words, first)[1])
        self.windows = {}
        for length, found in by_length.items():
            hashes, owners, places = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.windows[length] = (hashes[order], owners[order], places[order])

    def _same(self, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """Whether the words from ``at`` on are those of the benchmark from ``places`` on."""
        known = np.ndarray((len(self.padded) - 7,), "<u8", self.padded, strides=(1,))
        step = np.arange(length)
        i, j = ((x[:, None] + step).ravel() for x in (at, places))
        return kernel.equal_spans(eights, starts[i], ends[i], known, self.starts[j], self.ends[j]).reshape(-1, length).all(1)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's first word; whether each word is hit; and for each occurrence of a window its position and an item that has it."""
        begin, end, first = kernel.word_spans(data, offsets, kernel.ALNUM)
        eights = kernel.lanes(data, kernel.ALNUM)
        words = kernel.span_hashes(data, begin, end, kernel.ALNUM, eights)
        hit = np.zeros(len(words) + 1, np.int64)
        positions, owners = [], []
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for length, (known, items, places) in self.windows.items():
            if length == WINDOW:
                at, grams = kept_grams(words, first)
                at = at[_member(grams, self.grams)]
                starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            else:
                starts = np.arange(len(words))
            starts = starts[(starts >= 0) & (starts + length <= len(words))]
            starts = starts[text_of[starts] == text_of[starts + length - 1]] if len(starts) else starts
            hashes = np.zeros(len(starts), np.uint64)
            for k, c in enumerate(kernel.constants(length, 7)):
                hashes += words[starts + k] * c
            hashes = kernel.mix(hashes)
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            there = high > low
            starts, low, counts = starts[there], low[there], (high - low)[there]
            skip = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            entry, starts = np.repeat(low, counts) + skip, np.repeat(starts, counts)
            same = self._same(eights, begin, end, starts, places[entry], length)
            starts, entry = starts[same], entry[same]
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + length, -1)
            positions.append(starts)
            owners.append(items[entry])
        none = np.zeros(0, np.int64)
        return first, np.cumsum(hit)[:-1] > 0, np.concatenate([none, *positions]), np.concatenate([none, *owners])


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _digest(names: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _items_of(index: Index, first: np.ndarray, positions: np.ndarray, owners: np.ndarray) -> list[list[str]]:
    """Names of the items that each text has a window of."""
    found: list[list[str]] = [[] for _ in range(len(first) - 1)]
    rows = np.searchsorted(first, positions, side="right") - 1
    if len(rows):
        for row, part in zip(*_groups(np.unique(np.stack([rows, owners], 1), axis=0)), strict=True):
            found[row] = sorted({index.names[i] for i in part})
    return found


def judged(ids: pa.Array, texts: pa.Array, index: Index) -> Iterator[pa.RecordBatch]:
    none = _digest([])
    for a, b, data, offsets in kernel.text_slices(texts):
        first, hit, positions, owners = index.hits(data, offsets)
        so_far = np.concatenate([[0], np.cumsum(hit)])
        n_hit = so_far[first[1:]] - so_far[first[:-1]]
        found = _items_of(index, first, positions, owners)
        digests = [_digest(x) if x else none for x in found]
        yield pa.RecordBatch.from_arrays(
            [ids.slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(digests), pa.array(n_hit > 0), pa.array(found, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )


def _groups(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    rows, at = np.unique(pairs[:, 0], return_index=True)
    return rows.tolist(), np.split(pairs[:, 1], at[1:])


def _pieces(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Words of the items, in pieces that hold each window once: ``item_id, text, n``."""
    words = F.filter(F.split(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where("size(words) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - WINDOW + 1) / PIECE_WORDS).cast("int") - 1)
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("words", F.slice("words", F.col("piece") * PIECE_WORDS + 1, F.lit(PIECE_WORDS + WINDOW - 1)))
    return cut.select("item_id", F.array_join("words", " ").alias("text"), F.size("words").alias("n"))


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, index_words: int) -> tuple[int, Iterator[Index]]:
    """The number of blocks, and their indexes one after the other."""
    pieces = _pieces(benchmark, item_col, text_col)
    # Words of thousands of letters count for more.
    total = pieces.agg(F.sum(F.greatest(F.col("n"), F.ceil(F.length("text") / 32)))).first()[0] or 0
    n = max(1, -(-total // index_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Index([tuple(r) for r in pieces.where(block == k).orderBy("item_id", "text").select("item_id", "text").collect()]) for k in range(n))


def _spans(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """From ``row, text``: of rows with hits the hit spans of words, and the items."""
    for batch in batches:
        for a, _, data, offsets in kernel.text_slices(batch.column(1)):
            first, hit, positions, owners = index.hits(data, offsets)
            if not hit.any():
                continue
            found = _items_of(index, first, positions, owners)
            so_far = np.concatenate([[0], np.cumsum(hit)])
            for row in np.flatnonzero(so_far[first[1:]] > so_far[first[:-1]]).tolist():
                own = np.diff(hit[first[row] : first[row + 1]].astype(np.int8), prepend=0, append=0)
                spans = [{"a": x, "b": y} for x, y in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + row, 1), pa.array([spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([found[row]], pa.list_(pa.string()))], names=["row", "spans", "items"])


def _hits(rows: DataFrame, indexes: Iterable[Index], scratch: Scratch) -> DataFrame:
    """``row, spans, items`` for each block that hits a row, from ``row, text``: a pass over the rows for each."""
    found = None
    for index in indexes:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def judge(batches, shared=shared):
            yield from _spans(batches, shared.value)

        part = scratch.keep(rows.mapInArrow(kernel.tidy(judge), "row long, spans array<struct<a: long, b: long>>, items array<string>"), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _held(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows written under a number of their own; their columns are in a struct, so names can't clash."""
    return scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks, indexes = _indexes(benchmark, item_col, item_text_col, index_words)
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(indexes))

        @kernel.tidy
        def judge(batches):
            for batch in batches:
                yield from judged(batch.column(0), batch.column(1), shared.value)

        return docs.mapInArrow(judge, SCHEMA)

    @kernel.tidy
    def count(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.text_slices(batch.column(2)):
                n = np.diff(kernel.word_spans(data, offsets, kernel.ALNUM)[2])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(n, pa.int64())], names=["row", "doc_id", "n_words"])

    scratch = Scratch(docs.sparkSession)
    held = _held(docs, scratch).select("row", "doc.doc_id", "doc.text")
    counts = scratch.keep(held.mapInArrow(count, "row long, doc_id long, n_words long"), "counts")
    merged = _hits(held.select("row", "text"), indexes, scratch).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Words covered by spans in order: of each, those behind the furthest end so far.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
    covered = F.aggregate("spans", start, lambda got, x: F.struct((got["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], got["until"]))).alias("n"), F.greatest(got["until"], x["b"]).alias("until")), lambda got: got["n"])
    out = counts.join(merged.select("row", covered.alias("n_hit"), "items"), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), items.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """The documents without a hit word, row by row, in their own columns."""
    blocks, indexes = _indexes(benchmark, "item_id", "text", index_words)
    if blocks > 1:
        scratch = Scratch(docs.sparkSession)
        held = _held(docs, scratch)
        gone = scratch.keep(_hits(held.select("row", F.col("doc").getField(text_col).alias("text")), indexes, scratch).select("row").distinct(), "gone")
        return held.join(bounded(gone, gone.count()), "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(next(indexes))

    @kernel.tidy
    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            clean = [np.zeros(0, dtype=bool)]
            for _, _, data, offsets in kernel.text_slices(batch.column(at)):
                first, hit, _, _ = shared.value.hits(data, offsets)
                so_far = np.concatenate([[0], np.cumsum(hit)])
                clean.append(so_far[first[1:]] == so_far[first[:-1]])
            yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)
