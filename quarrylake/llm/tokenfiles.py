"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by descending frequency over the whole corpus (ties by id), so the 256 most frequent
take one byte.  Of every four values the lengths (1 to 4 bytes) go to one control byte, two bits each,
the first value lowest; their bytes, low first, go to a separate data stream.  numpy decodes with a table
of the four lengths of each control byte.

A file is a Parquet table of blocks, written and read by Spark so that it may lie in any store and a lost
task leaves nothing behind.  Columns: ``shard`` and ``block`` (order), ``start`` (tokens of the shard before
the block), ``n_tokens`` and ``payload``.  A payload is: the magic bytes ``QLT1``; the number of documents,
control bytes and data bytes (64-bit, little-endian); the documents' ids (64-bit) and token counts (32-bit);
the control bytes, each document beginning a new one; the data bytes.  Beside the blocks lies ``ranks``, the
table of ids by rank.

The text is encoded once, to plain ids in the shared folder; counts, ranks and files are made from those.
It is cut where the tokenizer's own pattern always cuts (before a single space or line break between
visible characters, and between a letter and punctuation), so pieces can be encoded apart.  Equal pieces are
encoded once by the library and looked up by hash after that, in a table of fixed size; a piece found there
is compared byte by byte.  Shards are ranges of the order, of about ``SHARD_BYTES`` of text, so rows that
share an id may lie in several.

Defined cases: strings of special tokens inside a text become those tokens, as the library has it unless told
otherwise (``special=False``: ordinary text); null and empty texts have the end id only; null ids come first
and are read back as null; rows that repeat an id are each written, in the order of a hash of their tokens;
an empty table gives no blocks; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import Scratch, arrow_rows, fresh_path

END_ID = 0
#: Bytes of text to a shard, shards beyond which they grow (tasks a driver can schedule; they are sorted
#: with spilling and written block by block, so a task's memory stays the same), and tokens to a block.
SHARD_BYTES, MANY_SHARDS, BLOCK_TOKENS = 24 << 20, 50_000, 1 << 20
#: Bytes of text encoded at once, and rows of an Arrow batch while files are written.
TEXT_BYTES, BATCH_ROWS = 1 << 19, 1000
MAGIC = b"QLT1"
NULL_ID = np.iinfo(np.int64).min

# ---------------------------------------------------------------------------------------------- coding

#: The four lengths of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _slots(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and which of their slots hold values."""
    control = (counts + 3) // 4
    used = np.ones(int(control.sum()) * 4, dtype=bool)
    ends = np.cumsum(control) * 4
    for spare in (1, 2, 3):
        rows = (control * 4 - counts) >= spare
        used[ends[rows] - spare] = False
    return control, used


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents laid end to end, and how many of each every document has."""
    values = np.ascontiguousarray(values, np.uint32)
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    control, used = _slots(counts)
    codes = np.zeros(len(used), np.uint8)
    codes[used] = lengths - 1
    packed = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < lengths[:, None]]
    so_far = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.bitwise_or.reduce(packed, axis=1), data, control, np.diff(so_far[ends])


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values again, by looking each control byte up in :data:`LENGTHS`."""
    lengths = LENGTHS[control].ravel()[_slots(counts)[1]]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    values = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        if (longer := lengths > k).any():
            values[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values & _KEEP[lengths]


def pack(ids: np.ndarray, counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    sizes = np.array([len(ids), len(control), len(data)], "<i8").tobytes()
    return b"".join((MAGIC, sizes, ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control, data))


def unpack(payload) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, token counts and all values of one block."""
    if bytes(payload[:4]) != MAGIC:
        raise ValueError("not a block of token ids")
    n, n_control, n_data = np.frombuffer(payload, "<i8", 3, 4).tolist()
    ids = np.frombuffer(payload, "<i8", n, 28)
    counts = np.frombuffer(payload, "<u4", n, 28 + 8 * n).astype(np.int64)
    at = 28 + 12 * n
    control = np.frombuffer(payload, np.uint8, n_control, at)
    return ids, counts, decode(control, np.frombuffer(payload, np.uint8, n_data, at + n_control), counts)


# ------------------------------------------------------------------------------------------- tokenizing

_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = _GRAPH & ~_LETTER
_MARK[0x30:0x3A] = False
_MARK[ord("'")] = False
#: First bytes of characters that are never white space, by length.
_LEAD2, _LEAD3, _LEAD4 = (np.zeros(256, dtype=bool) for _ in range(3))
_LEAD2[0xC3:0xE0] = True
_LEAD3[[0xE0, *range(0xE4, 0xF0)]] = True
_LEAD4[0xF0:0xF5] = True
_STARTS = _GRAPH | _LEAD2 | _LEAD3 | _LEAD4


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i - by], False where that is outside."""
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece, in order; each text begins one (empty texts share theirs)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    multi = data >= 0x80
    visible = _GRAPH[data]
    letter = _LETTER[data]
    if multi.any():
        visible |= multi & _shifted(_LEAD2[data], 1)
        letter |= multi & _shifted(data == 0xC3, 1) & (data != 0x97) & (data != 0xB7)
        if (data >= 0xE0).any():
            visible |= multi & (_shifted(_LEAD3[data], 2) | _shifted(_LEAD4[data], 3))
    gap = ((data == 0x20) | (data == 0x0A)) & _shifted(visible, 1) & _shifted(_STARTS[data], -1)
    cut = gap | _shifted(gap & (data == 0x0A), 1) | (_MARK[data] & _shifted(letter, 1))
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of many texts, each different piece encoded once while it stays in the table."""

    #: Places of the table (two to a set) and pieces kept before it is emptied.
    SLOTS, ENTRIES = 1 << 22, 3 << 19

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.vocabulary = self.library.get_vocab_size()
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        # Entry 0 stands for none: it has no ids, and a piece is never empty.
        self.entries = np.zeros(self.SLOTS, np.int32)
        self.hashes, self.starts, self.sizes = np.zeros(1, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.text_ends = np.zeros(1, np.int64)  # where in ``text`` the bytes of each piece end
        self.flat, self.text = np.zeros(1, self.kind), np.zeros(8, np.uint8)
        self.n, self.used = 1, 0

    def _room(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if len(old) < size:
            new = np.zeros(max(size, len(old) * 5 // 4), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _learn(self, pieces: list[bytes], hashes: np.ndarray) -> np.ndarray:
        found = [x.ids for x in self.batch([p.decode("utf-8", "surrogatepass") for p in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum()))
        first, last, before = self.n, self.n + len(found), int(self.text_ends[self.n - 1])
        ends = before + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self._room("flat", self.used + len(flat))
        self._room("text", int(ends[-1]) + 8)
        for name in ("hashes", "starts", "sizes", "text_ends"):
            self._room(name, last)
        self.flat[self.used : self.used + len(flat)] = flat
        self.text[before : int(ends[-1])] = np.frombuffer(b"".join(pieces), np.uint8)
        self.hashes[first:last], self.sizes[first:last], self.text_ends[first:last] = hashes, sizes, ends
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = last, self.used + len(flat)
        return np.arange(first, last)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces; a text with the string of a special token is one piece."""
        starts = cuts(data, offsets)
        raw = data.tobytes() if self.special else b""
        whole = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        for row in whole:
            starts = starts[(starts <= offsets[row]) | (starts >= offsets[row + 1])]
        return starts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, without end ids, and how many each text has."""
        if self.n > self.ENTRIES or self.used > 8 * self.ENTRIES or len(self.text) > 32 * self.ENTRIES:
            self.clear()
        starts = self._pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        eights = kernel.lanes(data, kernel.EXACT)
        hashes = kernel.span_hashes(data, starts, ends, kernel.EXACT, eights)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = self.entries[slot].astype(np.int64)
        other = np.flatnonzero(self.hashes[entry] != hashes)
        entry[other] = self.entries[slot[other] ^ 1]  # the other place of the set
        missing = other[(self.hashes[entry[other]] != hashes[other]) | (entry[other] == 0)]
        own = lambda rows: [data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
        if len(missing):
            _, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[at]
            new = self._learn(own(first), hashes[first])
            entry[missing] = new[back]
            # Of a set's two places an empty one, or else the own one.
            place = slot[first]
            self.entries[np.where((self.entries[place] > 0) & (self.entries[place ^ 1] == 0), place ^ 1, place)] = new
        known = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        alike = np.flatnonzero(~kernel.equal_spans(eights, starts, ends, known, self.text_ends[np.maximum(entry - 1, 0)], self.text_ends[entry]))
        if len(alike):  # other pieces by their bytes, which only share a hash
            entry[alike] = self._learn(own(alike), hashes[alike])
        sizes = self.sizes[entry].astype(np.int64)
        ends_at = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[entry] - (ends_at - sizes), sizes) + np.arange(ends_at[-1])]
        before = np.concatenate([[0], ends_at])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process, file and way."""
    return kernel.held(("encoder", path, special), lambda: Encoder(path, special))


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text, and the new counts."""
    out = np.full(len(ids) + len(counts), END_ID, np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


# ---------------------------------------------------------------------------------------------- writing


def encoded(rows: DataFrame, tokenizer: str, special: bool = True) -> DataFrame:
    """From ``doc_id, order, text``: ``doc_id, order, n_tokens, ids`` with the end ids, as 32-bit numbers if ids need that, else 16."""

    @kernel.tidy
    def code(batches):
        coder = encoder(tokenizer, special)
        for batch in batches:
            for a, b, data, offsets in kernel.text_slices(batch.column(2), TEXT_BYTES):
                ids, n_tokens = with_ends(*coder.encode(data, offsets))
                ids = ids.astype(coder.kind)
                at = np.concatenate([[0], np.cumsum(n_tokens)]) * ids.itemsize
                held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n_tokens), held], names=["doc_id", "order", "n_tokens", "ids"])

    return rows.mapInArrow(code, f"doc_id long, order {rows.schema['order'].dataType.simpleString()}, n_tokens long, ids binary")


def _flat(ids: pa.Array, n_tokens: np.ndarray) -> np.ndarray:
    """All ids of a column of them."""
    data, offsets = kernel.string_buffers(ids.cast(pa.large_binary()))
    data, total = data[offsets[0] : offsets[-1]], int(n_tokens.sum())
    return data.view(np.uint16 if len(data) == 2 * total else np.uint32)


def token_counts(raw: DataFrame, vocabulary: int) -> DataFrame:
    """``id, n`` over all encoded texts; each task sends one row an id at most."""

    @kernel.tidy
    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(1), batch.column(0).to_numpy()), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return raw.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch], rank: np.ndarray, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, doc_id, n_tokens, ids) in order, gathered into blocks."""
    shard, block, start, held, size = None, 0, 0, [], 0

    def flush():
        nonlocal block, start, held, size
        ids, counts, values = (np.concatenate(x) for x in zip(*held, strict=True))
        control, data, _, _ = encode(rank[values], counts)
        payload = pack(ids, counts, control.tobytes(), data.tobytes())
        out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "block", "start", "n_tokens", "payload"])
        block, start, held, size = block + 1, start + size, [], 0
        return out

    for batch in batches:
        if shard is None and batch.num_rows:
            shard = batch.column(0)[0].as_py()
        counts = batch.column(2).to_numpy()
        # The rows that still go into the open block, and so on.
        row = 0
        while row < batch.num_rows:
            until = min(batch.num_rows, row + 1 + int(np.searchsorted(np.cumsum(counts[row:]), block_tokens - size)))
            part = batch.slice(row, until - row)
            own = counts[row:until]
            held.append((part.column(1).fill_null(NULL_ID).to_numpy(), own, _flat(part.column(3), own).copy()))
            size += int(own.sum())
            row = until
            if size >= block_tokens:
                yield flush()
    if held:
        yield flush()


def file_order(docs: DataFrame) -> Column | None:
    """The place of each row in the files a table is read from; None for other tables."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        return None
    return place


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, special: bool = True) -> None:
    """Write the token ids of all texts to a folder, in ascending order of ids, or of the given column."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(id_col).cast("long") if order is None else order).alias("order"), F.col(text_col).alias("text"))
    with arrow_rows(spark, BATCH_ROWS):
        raw = scratch.keep(encoded(rows, tokenizer, special), "token-ids")
        vocabulary = max(Encoder(tokenizer).vocabulary, END_ID + 1)
        counts = token_counts(raw, vocabulary).orderBy(F.desc("n"), "id").select("id").collect()  # a row an id of the vocabulary
    by_rank = [r.id for r in counts]
    spark.createDataFrame([(k, i) for k, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(vocabulary, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    size = 5 * (raw.agg(F.sum("n_tokens")).first()[0] or 0)  # about five bytes of text to a token
    n = max(1, min(MANY_SHARDS, -(-size // SHARD_BYTES)))
    shared, block_tokens = spark.sparkContext.broadcast(rank), BLOCK_TOKENS

    @kernel.tidy
    def blocks(batches):
        return _blocks(batches, shared.value, block_tokens)

    keyed = raw.withColumn("tie", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange(int(n), "order", "tie").sortWithinPartitions("order", "tie").select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "ids")
    with arrow_rows(spark, BATCH_ROWS):
        ordered.mapInArrow(blocks, "shard int, block int, start long, n_tokens long, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop_all()


# ---------------------------------------------------------------------------------------------- reading


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32, shard, block``, from the files alone."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    by_rank = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    blocks = spark.read.parquet(f"{path}/blocks")

    @kernel.tidy
    def documents(batches):
        for batch in batches:
            for shard, block, start, payload in zip(*(batch.column(k) for k in ("shard", "block", "start", "payload")), strict=True):
                ids, counts, values = unpack(payload.as_buffer())
                tokens = by_rank.value[values]
                ends = np.cumsum(counts)
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array(np.full(len(ids), shard.as_py(), np.int32)), pa.array(np.full(len(ids), block.as_py(), np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"],
                )

    found = blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int")
    # A row a shard; their running sum needs one task.
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, special: bool = True) -> DataFrame:
    """Write the files and return what reading them gives."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col, text_col, order, special)
    return read(docs.sparkSession, path)
