"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight a hashed feature is shared by all grades, and ordered thresholds cut the same scale:
``P(grade <= k) = sigmoid(threshold_k - weight . x)``.  That gives an expected grade and, for selection,
the probability of reaching a given grade.  Thresholds stay ordered as each is the one before plus an
exponential.

Features of a text are, for each word (run of anything but white space): the folded word, its last three
bytes, its shape (length, first and last byte's class), and whether it repeats the word before.  Each kind has
its own buckets; ``x`` is the share of the words in a bucket, so long and short texts compare.

Learning reads at most ``DOCS`` rated documents of each grade, picked by hash, and gives every grade the same
weight, however rare.  It reads their whole texts, as scoring does: executors count the features, and the driver
gets, of each document, its buckets and their counts.  Grades are any whole numbers from 0 on; those that are
rated are the model's levels.

Defined cases: null and empty texts have no features and get the grade of the thresholds alone; null ratings
are not learned from; with fewer than two grades every document has the one known grade (or 0);
null ids are kept; rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BUCKETS, KINDS = 1 << 15, 4
DOCS = 3000
EPOCHS, BATCH, RATE, DECAY, SCALE = 20, 64, 0.2, 1e-4, 4.0
SAMPLE = "doc_id string, grade int, turn long, n_words long, used binary, times binary"
SCHEMA = "doc_id long, expected_grade double, tail_prob double, grade int"
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (words by kinds), and for each text the index of its first word."""
    starts, ends, first = kernel.word_spans(data, offsets, kernel.SPACED)
    out = np.zeros((len(starts), KINDS), np.int32)
    if not len(starts):
        return out, first
    words = kernel.span_hashes(data, starts, ends, kernel.SPACED)
    tails = kernel.span_hashes(data, np.maximum(starts, ends - 3), ends, kernel.SPACED)
    shape = np.minimum(ends - starts, 31).astype(np.uint64) << np.uint64(6) | _CLASS[data[starts]] << np.uint64(3) | _CLASS[data[ends - 1]]
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][np.diff(first) > 0]] = 0
    for k, h in enumerate((words, tails, kernel.mix(shape), kernel.mix(same))):
        out[:, k] = (h >> np.uint64(64 - 15)).astype(np.int32) + k * BUCKETS
    return out, first


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the words' values for each text; 0 without words."""
    out, n = np.zeros(len(first) - 1), np.diff(first)
    if n.any():  # summed text by text, so equal texts agree to the last bit
        out[n > 0] = np.add.reduceat(values, first[:-1][n > 0]) / n[n > 0]
    return out


class Model:
    def __init__(self, levels: list[int]):
        self.weights = np.zeros(BUCKETS * KINDS)
        self.levels = np.array(levels, np.int64)
        self.grades = len(levels)
        self.low, self.gaps = 0.0, np.zeros(max(0, self.grades - 2))

    @property
    def thresholds(self) -> np.ndarray:
        return self.low + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])[: max(0, self.grades - 1)]

    def beyond(self, scale: np.ndarray) -> np.ndarray:
        """P(grade > k) for k below the top (texts by thresholds)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scale[:, None], -60, 60)))

    def reach(self, beyond: np.ndarray, grade: int | None) -> np.ndarray:
        """P(at least this grade), the top one if none is given."""
        k = self.grades - 1 if grade is None else int(np.searchsorted(self.levels, grade))
        if 0 < k < self.grades:
            return beyond[:, k - 1]
        return np.full(len(beyond), float(k == 0))

    def expected(self, beyond: np.ndarray) -> np.ndarray:
        return self.levels[0] + beyond @ np.diff(self.levels)

    def scale(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, first = features(data, offsets)
        return SCALE * means(self.weights[buckets].sum(1), first)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc_id, grade, turn, text``: each text's number of words, and the buckets of its features with counts."""
    for batch in batches:
        for a, b, data, offsets in kernel.text_slices(batch.column(3)):
            buckets, first = features(data, offsets)
            own = [np.unique(buckets[i:j], return_counts=True) for i, j in zip(first[:-1], first[1:], strict=True)]
            used, times = (pa.array([x[k].astype(np.int32).tobytes() for x in own], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(np.diff(first).astype(np.int64)), used, times], names=["doc_id", "grade", "turn", "n_words", "used", "times"])


def train(sizes: np.ndarray, used: list[bytes], times: list[bytes], rated: np.ndarray, seed: int = 3) -> Model:
    """Fit weights and thresholds (Adagrad on the log-likelihood with all grades in balance, with weight decay)."""
    levels, grades, found = np.unique(rated, return_inverse=True, return_counts=True)
    top = len(levels)
    model = Model(levels.tolist() or [0])
    if top < 2:
        return model
    balance = len(grades) / (top * found)
    share = np.arange(top - 1, 0, -1) / top
    cut = np.maximum.accumulate(-np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))) + np.arange(top - 1) * 1e-3)
    model.low, model.gaps = float(cut[0]), np.log(np.maximum(np.diff(cut), 1e-3))
    seen, seen_cut = np.full(len(model.weights), 1e-6), np.full(top - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grades))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            n = np.maximum(sizes[part], 1)
            own, count = (np.frombuffer(b"".join(x[i] for i in part), np.int32) for x in (used, times))
            row = np.repeat(np.arange(len(part)), [len(used[i]) // 4 for i in part])
            x = SCALE * np.bincount(row, model.weights[own] * count, len(part)) / n
            # P(y) = F(t_y - x) - F(t_(y-1) - x); slopes of its log by x and by the thresholds.
            t, y = model.thresholds, grades[part]
            upper = np.where(y < top - 1, t[np.minimum(y, top - 2)] - x, 60.0)
            lower = np.where(y > 0, t[np.maximum(y - 1, 0)] - x, -60.0)
            f, g = (1 / (1 + np.exp(-np.clip(v, -60, 60))) for v in (upper, lower))
            p = np.maximum(f - g, 1e-9)
            du, dl = balance[y] * f * (1 - f) / p, -balance[y] * g * (1 - g) / p
            dt = np.zeros(top - 1)
            np.add.at(dt, y[y < top - 1], du[y < top - 1])
            np.add.at(dt, y[y > 0] - 1, dl[y > 0])
            dt /= len(part)
            dx = -(du + dl) * SCALE / n / len(part)
            different, at = np.unique(own, return_inverse=True)
            slope = np.bincount(at, dx[row] * count, len(different)) - DECAY * model.weights[different]
            seen[different] += slope**2
            model.weights[different] += RATE * slope / np.sqrt(seen[different])
            dcut = np.append(dt.sum(), [dt[k + 1 :].sum() * np.exp(model.gaps[k]) for k in range(top - 2)])
            seen_cut += dcut**2
            step = RATE * dcut / np.sqrt(seen_cut)
            model.low += step[0]
            model.gaps += step[1:]
    return model


def learn(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model from a bounded sample of rated documents."""
    known = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where("grade >= 0 AND doc_id IS NOT NULL")
    turn = F.xxhash64("doc_id", F.lit(78))
    picked = None
    for level in sorted(r.grade for r in known.select("grade").distinct().collect()):
        part = known.where(F.col("grade") == level).orderBy(turn, "doc_id").limit(DOCS)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return Model([0])
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = named.join(F.broadcast(picked.distinct()), "doc_id").select(F.col("doc_id").cast("string"), "grade", F.xxhash64("text").alias("turn"), "text").mapInArrow(counted, SAMPLE)
    # Rows that repeat an id: one of each id and grade, so the sample stays within its bound.
    one = rows.groupBy("doc_id", "grade").agg(F.min_by(F.struct("n_words", "used", "times"), "turn").alias("x")).select("doc_id", "grade", "x.*")
    found = one.toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    return train(found["n_words"].to_numpy(), found["used"].to_pylist(), found["times"].to_pylist(), found["grade"].to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", tail: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, expected_grade, tail_prob`` (of reaching grade ``tail``, the top one if not given) ``, grade``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @kernel.tidy
    def judge(batches):
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in kernel.text_slices(batch.column(1)):
                beyond = model.beyond(model.scale(data, offsets))
                given = model.levels[(beyond > 0.5).sum(1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.expected(beyond)), pa.array(model.reach(beyond, tail)), pa.array(given)], names=["doc_id", "expected_grade", "tail_prob", "grade"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, SCHEMA)


def select_quality(docs: DataFrame, model: Model, least: float, id_col: str = "doc_id", text_col: str = "text", tail: int | None = None) -> DataFrame:
    """The documents that reach grade ``tail`` with a probability of at least ``least``, in their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @kernel.tidy
    def keep(batches):
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found = [model.reach(model.beyond(model.scale(d, o)), tail) for _, _, d, o in kernel.text_slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *found]) >= least))

    return docs.mapInArrow(keep, docs.schema)
