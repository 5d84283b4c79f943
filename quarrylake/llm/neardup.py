"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct shingles of ``SHINGLE`` words.  Every shingle gives each of ``REGISTERS``
registers an exponentially distributed value; a register keeps ``floor(1 - log_b(minimum))``, cut to two
bytes.  Registers of a union are the larger of both (mergeable), and two sets agree in a register about
as often as their Jaccard similarity (locality-sensitive).

1. Documents with equal sets form a class; only the smallest id of each goes on.
2. Bands of ``ROWS`` registers are hashed.  A pair at the threshold of 0.8 misses all ``BANDS`` bands with
   a chance below 1e-6.
3. Of the buckets a document is in, the hub (smallest member) that it shares most bands with is tested
   first.  A pair inside one component needs no test any more, so a bucket of many copies costs each
   document one test.  Where a bucket still holds several components, ``ROUNDS`` further rounds test each
   document with the two likeliest of other hubs.
4. A candidate's similarity is estimated from all registers and both set sizes by maximum likelihood;
   below ``CUT`` (six standard errors under the threshold) it goes no further.  The rest are confirmed on
   the full sets, from the whole texts; shingles that agree by hash are compared byte by byte.
5. What is undecided then is compared without exception.  In each bucket the documents outside its largest
   component are estimated against all its documents, block by block; components with a likely pair form a
   field (a block gives a spanning subset of them, never its pairs).  Inside a field the same blocks are
   compared on full sets, as hashes, leaving out what the estimate rules out and what is connected by then;
   at most one pair for each document and component comes out and is confirmed like any other.  Pairs of
   blocks are dealt over the tasks one by one, so a large bucket or field isn't bound to one.
6. Links become components by joins.

Two documents whose sets have the same 128-bit digest count as equal (step 1); any other link is confirmed
on the texts.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with
nothing; rows with null ids are returned with a null component and kept; rows that repeat an id are
each returned; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import Scratch, arrow_rows, bounded, materialize
from .components import components, forest

SHINGLE = 5
ROWS, BANDS = 6, 48
REGISTERS = ROWS * BANDS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
THRESHOLD, CUT = (80, 100), 0.66
#: Further rounds of hubs, and members of open buckets that are compared at once without them.
ROUNDS, FEW_OPEN = 2, 20_000
#: Documents and shingles of a block, on average, in the last comparison; pairs of a hub confirmed by one task.
BLOCK_DOCS, BLOCK_SHINGLES, HUB_PAIRS = 256, 1 << 18, 256

_XOR = kernel.constants(REGISTERS, 11).astype(np.uint32)
_MUL = (kernel.constants(REGISTERS, 12) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text (with repeats), and for each text the index of its first."""
    return word_shingles(*kernel.hashed_words(data, offsets, kernel.SPACED), size)


def word_shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the words' hashes."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(starts[-1]), np.uint64)
    long = n >= size
    if long.any():
        grams = kernel.gram_hashes(words, size, 21)
        at = np.repeat(first[:-1] - starts[:-1], count) + np.arange(len(out))
        full = np.repeat(long, count)
        out[full] = grams[at[full]]
    for k in np.unique(n[(n > 0) & ~long]):  # fewer words: the whole sequence is the one shingle
        rows = np.flatnonzero(n == k)
        total = np.zeros(len(rows), np.uint64)
        for j, c in enumerate(kernel.constants(int(k), 100 + int(k))):
            total += words[first[:-1][rows] + j] * c
        out[starts[:-1][rows]] = kernel.mix(total)
    return out, starts


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (texts by registers); empty sets have zeros."""
    n = len(starts) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return out
    values, at = (hashes >> np.uint64(32)).astype(np.uint32), starts[:-1][some]
    lowest, scratch = np.empty((REGISTERS, len(some)), np.uint32), np.empty_like(values)
    for i in range(REGISTERS):
        np.bitwise_xor(values, _XOR[i], out=scratch)
        np.multiply(scratch, _MUL[i], out=scratch)
        np.minimum.reduceat(scratch, at, out=lowest[i])
    exponential = -np.log1p(-(lowest.T + 0.5) / 2.0**32) / RATE
    out[some] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit key of each band, with the band in it."""
    keys = np.zeros((len(regs), BANDS), np.uint64)
    shaped = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    for j, c in enumerate(kernel.constants(ROWS, 31)):
        keys += (shaped[:, :, j] + np.uint64(1)) * c
    return kernel.mix(keys + kernel.constants(BANDS, 32)[None, :])


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 50) -> np.ndarray:
    """Joint maximum-likelihood similarity of register rows, given the set sizes."""
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, steps + 1):
        j = top * step
        more, less = p(u - v * j), p(v - u * j)
        like = above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + equal * np.log(np.maximum(1 - more - less, 1e-12))
        better = like > best
        best[better], found[better] = like[better], j[better]
    return found


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float = CUT) -> np.ndarray:
    """Whether the joint maximum-likelihood similarity is ``least`` or more: the likelihood, which has one peak, still rises there."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = na / (na + nb), nb / (na + nb)
    like = []
    for j in (least, np.minimum(least + 0.01, np.minimum(u / v, v / u))):
        more, less = (-np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j))
        like.append(above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + equal * np.log(np.maximum(1 - more - less, 1e-12)))
    return (like[1] >= like[0]) & (np.minimum(u / v, v / u) >= least)


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, regs binary, keys array<long>"


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    @kernel.tidy
    def sign(batches):
        kernel.release()
        for batch in batches:
            ids, texts = batch.columns
            for a, b, data, offsets in kernel.text_slices(texts):
                hashes, starts = shingle_hashes(data, offsets, shingle)
                sets = [np.unique(hashes[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                regs = registers(hashes, starts)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(band_keys(regs).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary()), keys],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "regs", "keys"],
                )

    return docs.mapInArrow(sign, SKETCH)


def _as_registers(column: pa.Array) -> np.ndarray:
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint16, count=len(column) * REGISTERS, offset=int(offsets[0])).reshape(-1, REGISTERS)


def _named_by(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a table whose id is in a (written) table of pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return table.join(bounded(ids, 2 * pairs.count()), "doc_id", "left_semi")


def _estimated(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose sizes and registers allow the threshold: ``a, b``."""
    members = _named_by(pairs, members)
    side = lambda x: members.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    sized = joined.where(F.least("n_a", "n_b") * THRESHOLD[1] >= F.greatest("n_a", "n_b") * THRESHOLD[0])

    @kernel.tidy
    def estimate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                a, b, na, nb, ra, rb = batch.slice(at, 2000).columns
                keep = pa.array(reaches(_as_registers(ra), _as_registers(rb), na.to_numpy(), nb.to_numpy()))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, "a long, b long")


class _Shingled:
    """A text's set of shingles, where each first stands, and the bytes of its words."""

    def __init__(self, text: pa.Scalar, shingle: int):
        data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
        self.eights = kernel.lanes(data, kernel.SPACED)
        self.starts, self.ends, first = kernel.word_spans(data, np.array([0, len(data)]), kernel.SPACED)
        words = kernel.span_hashes(data, self.starts, self.ends, kernel.SPACED, self.eights)
        self.hashes = word_shingles(words, first, shingle)[0]
        self.set = np.unique(self.hashes)
        self.words = min(shingle, len(self.starts))

    def first_of(self, wanted: np.ndarray) -> np.ndarray:
        """Where each of some shingles first stands."""
        order = np.argsort(self.hashes, kind="stable")
        return order[np.searchsorted(self.hashes, wanted, sorter=order)]

    def common(self, other: "_Shingled") -> int:
        """Shingles that both sets have, byte by byte."""
        if self.words != other.words:
            return 0
        both = np.intersect1d(self.set, other.set, assume_unique=True)
        step = np.arange(self.words)
        i, j = ((x.first_of(both)[:, None] + step).ravel() for x in (self, other))
        same = kernel.equal_spans(self.eights, self.starts[i], self.ends[i], other.eights, other.starts[j], other.ends[j])
        return int(same.reshape(-1, self.words).all(1).sum())


def linked(one: _Shingled, two: _Shingled) -> bool:
    """Whether two texts have the threshold's similarity, on full sets."""
    sizes = len(one.set), len(two.set)
    both = len(np.intersect1d(one.set, two.set, assume_unique=True))
    return bool(_similar(both, *sizes) and _similar(one.common(two), *sizes))


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Test (written) pairs on their full sets: ``a, b, linked``.

    The other texts are dealt to parts of ``HUB_PAIRS`` pairs of one hub, and the hub's text to each part.
    """
    texts = _named_by(pairs, docs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("parts"))
    parted = pairs.join(bounded(parts, pairs.count()), "a").select("a", "b", F.pmod(F.xxhash64("b", F.lit(9)), F.col("parts")).alias("part"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a")
    joined = parted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b").join(hubs, ["a", "part"])

    @kernel.tidy
    def confirm(batches):
        kernel.release()
        hub, held = None, None
        for batch in batches:
            ids, others, ta, tb = batch.columns
            found = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, left, right) in enumerate(zip(ids.to_pylist(), ta, tb, strict=True)):
                if hub != a or held[0] != left:  # an id may have several texts
                    hub, held = a, (left, _Shingled(left, shingle))
                found[i] = linked(held[1], _Shingled(right, shingle))
            yield pa.RecordBatch.from_arrays([ids, others, pa.array(found)], names=["a", "b", "linked"])

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(confirm, "a long, b long, linked boolean")


def _similar(both, one, two):
    return (both > 0) & (THRESHOLD[1] * both >= THRESHOLD[0] * (one + two - both))


def _likeliest(pairs: DataFrame, n: int) -> DataFrame:
    """Of each b, the n pairs with most bands in common (ties: the smallest a)."""
    best = F.struct((-F.col("count")).alias("order"), F.col("a"))
    top = F.min(best) if n == 1 else None
    if top is not None:
        return pairs.groupBy("b").agg(top.alias("best")).select(F.col("best.a").alias("a"), "b")
    return pairs.groupBy("b").agg(F.min(best).alias("x"), F.min(F.struct(F.xxhash64("a", "b"), F.col("a"))).alias("y")).select("b", F.explode(F.array_distinct(F.array("x.a", "y.a"))).alias("a")).select("a", "b")


class _Search:
    """What the steps of one search share."""

    def __init__(self, docs: DataFrame, shingle: int, scratch: Scratch):
        self.docs, self.shingle, self.scratch, self.members = docs, shingle, scratch, None

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        found = _confirmed(pairs, self.docs, self.shingle)
        with arrow_rows(self.docs.sparkSession, 200):  # a row holds two texts
            return self.scratch.keep(found, "confirmed")

    def tested(self, pairs: DataFrame) -> DataFrame:
        """Estimated, and if likely enough confirmed: ``a, b, linked``."""
        return self.confirmed(self.scratch.keep(_estimated(self.scratch.keep(pairs, "pairs"), self.members), "likely"))

    def undecided(self, crowded: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """Members of buckets that hold several components, with a hub that changes with the turn."""
        labelled = crowded.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        hub = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("turn"), "doc_id", "component"))
        split = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), hub.alias("hub")).where("low <> high")
        split = self.scratch.keep(split.select("key", "low", F.col("hub.doc_id").alias("hub"), F.col("hub.component").alias("hub_component")), "split")
        return self.scratch.keep(labelled.join(bounded(split, split.count()), "key"), "undecided")

    def blocks(self, rows: DataFrame, group: str, payload: list[str]) -> DataFrame:
        """Pairs of blocks of each group, as lists ``one`` (outside the largest component) and ``two``.

        ``rows`` has the group, ``doc_id, component, n_shingles`` and the payload; a block's pairs with
        itself and with later blocks come out once.
        """
        rows = self.scratch.keep(rows, "open")
        counts = rows.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        largest = counts.groupBy(group).agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        sides = counts.join(largest, group).groupBy(group, "largest").agg(*[
            F.greatest(F.lit(1).cast("long"), F.ceil(F.sum(F.when(own, F.col("n"))) / BLOCK_DOCS), F.ceil(F.sum(F.when(own, F.col("size"))) / BLOCK_SHINGLES)).alias(name)
            for own, name in ((F.col("component") == F.col("largest"), "main"), (F.col("component") != F.col("largest"), "rest"))
        ])
        sides = self.scratch.keep(sides, "sides")
        rest = F.col("component") != F.col("largest")
        placed = rows.join(bounded(sides, sides.count()), group).select(group, "doc_id", "component", "n_shingles", *payload, "rest", "main", F.when(rest, F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("main"))).alias("block"))
        held = self.scratch.keep(placed.groupBy(group, "block", "rest", "main").agg(F.collect_list(F.struct("doc_id", "component", "n_shingles", *payload)).alias("rows")), "blocks")
        until = F.col("rest") + F.col("main") - 1
        one = held.where("block < rest").select(group, F.col("block").alias("i"), F.explode(F.sequence("block", until)).alias("j"), F.col("rows").alias("one"))
        two = held.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("block"), F.col("rest") - 1))).alias("i"), F.col("block").alias("j"), F.col("rows").alias("two"))
        return one.join(two, [group, "i", "j"]).select("one", "two")

    def fields(self, open_: DataFrame) -> DataFrame:
        """``component, field``: components that a chain of likely pairs joins."""
        sketched = open_.select("key", "doc_id", "component").join(self.members.select("doc_id", "n_shingles", "regs").dropDuplicates(["doc_id"]), "doc_id")

        @kernel.tidy
        def forest(batches):
            for batch in batches:
                for left, right in zip(batch.column(0), batch.column(1), strict=True):
                    a, b = _likely_forest(left.values, right.values)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        with arrow_rows(self.docs.sparkSession, 8):  # a row holds two blocks
            edges = self.scratch.keep(self.blocks(sketched, "key", ["regs"]).mapInArrow(forest, "a long, b long"), "edges")
        return components(edges, self.scratch).select(F.col("node").alias("component"), F.col("component").alias("field"))

    def field_links(self, open_: DataFrame) -> DataFrame:
        """All links between different components that aren't made yet, as a spanning subset: ``a, b, linked``."""
        there = self.scratch.keep(open_.select("doc_id", "component").distinct().join(self.fields(open_), "component"), "there")
        sketched = there.join(self.members.select("doc_id", "n_shingles", "regs").dropDuplicates(["doc_id"]), "doc_id")
        wanted = self.docs.join(bounded(there.select("doc_id").distinct(), there.count()), "doc_id", "left_semi")
        shingle = self.shingle

        @kernel.tidy
        def listed(batches):
            for batch in batches:
                for a, b, data, offsets in kernel.text_slices(batch.column(1)):
                    hashes, starts = shingle_hashes(data, offsets, shingle)
                    sets = [np.unique(hashes[i:j]).tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "set"])

        with arrow_rows(self.docs.sparkSession, 1000):
            sets = self.scratch.keep(wanted.mapInArrow(listed, "doc_id long, set binary"), "sets")

        @kernel.tidy
        def compare(batches):
            for batch in batches:
                for left, right in zip(batch.column(0), batch.column(1), strict=True):
                    found = _block_links(left.values, right.values)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        with arrow_rows(self.docs.sparkSession, 4):
            pairs = self.blocks(sketched.join(sets, "doc_id"), "field", ["regs", "set"])
            found = self.scratch.keep(pairs.mapInArrow(compare, "a long, b long").distinct(), "links")
        return self.confirmed(found)


def _columns(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [rows.field(n).to_numpy() for n in names]


def _likely_places(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents on the left and on the right, of different components, that may be linked."""
    (na, ca), (nb, cb) = (_columns(x, "n_shingles", "component") for x in (left, right))
    ra, rb = (_as_registers(x.field("regs")) for x in (left, right))
    low, high = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
    i, j = np.nonzero((ca[:, None] != cb[None, :]) & (low * THRESHOLD[1] >= high * THRESHOLD[0]))
    keep = [reaches(ra[i[a : a + 4096]], rb[j[a : a + 4096]], na[i[a : a + 4096]], nb[j[a : a + 4096]]) for a in range(0, len(i), 4096)]
    keep = np.concatenate([np.zeros(0, dtype=bool), *keep])
    return i[keep], j[keep]


def _likely_forest(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Components with a likely pair in two blocks, as few pairs of them as connect the same ones."""
    i, j = _likely_places(left, right)
    (ca,), (cb,) = (_columns(x, "component") for x in (left, right))
    return forest(ca[i], cb[j])


def _block_links(left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
    """Pairs between different components of two blocks that are linked by hash: at most one for each document and component."""
    (ia,), (ib, cb) = _columns(left, "doc_id"), _columns(right, "doc_id", "component")
    sa, sb = ([np.frombuffer(s.as_buffer(), np.uint64) for s in x.field("set")] for x in (left, right))
    found, met = [], set()
    for i, j in zip(*(x.tolist() for x in _likely_places(left, right)), strict=True):
        if (i, cb[j]) not in met and _similar(len(np.intersect1d(sa[i], sb[j], assume_unique=True)), len(sa[i]), len(sb[j])):
            met.add((i, cb[j]))
            found.append((min(ia[i], ib[j]), max(ia[i], ib[j])))
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    search = _Search(docs, shingle, scratch)
    signing = _signatures(docs, shingle)
    with arrow_rows(docs.sparkSession, 2000):
        sketches = scratch.keep(signing, "sketches")
    signed = scratch.keep(sketches.select("doc_id", "n_shingles", "set_a", "set_b"), "signed")
    known = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(signed.where(known).groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    # An id that several texts share names them all: links to one of them are links to that id.
    search.members = scratch.keep(sketches.where(known).join(bounded(reps, reps.count()), "doc_id", "left_semi"), "members")
    scratch.drop(sketches)
    buckets = search.members.select("doc_id", F.explode("keys").alias("key"))
    shared = scratch.keep(buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far")).where("hub <> far").select("key", "hub"), "shared")
    crowded = scratch.keep(buckets.join(bounded(shared, shared.count()), "key"), "buckets")
    first = crowded.where("doc_id <> hub").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).count()
    tested = search.tested(_likeliest(first, 1))
    links = tested.where("linked").select("a", "b")
    labels = components(links, scratch)
    for turn in range(ROUNDS + 1):
        open_ = search.undecided(crowded, labels, turn)
        n_open = open_.count()
        if not n_open:
            break
        if turn == ROUNDS or n_open <= FEW_OPEN:
            more = search.field_links(open_).where("linked").select("a", "b")
        else:
            pairs = open_.where("component <> hub_component").groupBy(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).count()
            fresh = search.tested(_likeliest(pairs.join(tested, ["a", "b"], "left_anti"), 2))
            tested = tested.unionByName(fresh)
            more = fresh.where("linked").select("a", "b")
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links, scratch)
        if n_open <= FEW_OPEN:
            break
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    scratch.drop_all(signed, classes, labels)
    return found


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input without the documents that are near copies of one with a smaller id."""
    gone = materialize(near_duplicates(docs, id_col, text_col, shingle).where("NOT kept").select(F.col("doc_id").alias(id_col)), "near-copies").distinct()
    return docs.join(bounded(gone, gone.count()), id_col, "left_anti")
