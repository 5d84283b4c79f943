"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as the embedding of its hash beside the mean embedding of its character
trigrams and prefixes.  Two gated recurrent layers, one each way, read a window of ``WINDOW`` words; attention pools
their states, and a logistic unit scores the window.  Windows overlap by half and cover the whole text;
the document's score is that of its worst window.

Labels are given per document, so learning is by multiple instances: each round takes, of every toxic
document, the window the present model finds worst, and of every clean document its worst and another
one.  The first round ranks windows by the words' log-odds, which also start one dimension of the word
embedding.  Gradients go through attention, both recurrent layers and both embeddings (Adam).

Learning reads at most ``DOCS`` labelled documents of each class, picked by hash, and all windows of each.  The
driver takes their texts in blocks and holds a number for each of their words.  Scoring has no such bounds.

Defined cases: null and empty texts, and texts without words, get the score of an empty window; null labels
are not learned from; without both classes every score is 0; null ids are kept; rows are judged one by one;
of rows that repeat an id, the first text is learned from, with all labels of the id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

WINDOW, STRIDE = 16, 8
WORDS, GRAMS, WORD_DIM, CHAR_DIM, HIDDEN = 1 << 15, 1 << 14, 8, 8, 8
#: Bytes of the prefixes that count as characters beside the trigrams.
PREFIXES = (4, 6, 8)
DOCS = 1500
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 128, 0.01
#: Steps that a round takes at least, where documents are few.
STEPS = 80
TOXIC = 0.7
SCHEMA = "doc_id long, score double, predicted int"
#: Windows scored at once.
CHUNK = 4096


# ------------------------------------------------------------------------------------------------ input


class Words:
    """Words of some texts: for each its row among the different words, and the inputs of those."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = kernel.word_spans(data, offsets, kernel.ALNUM)
        hashes = kernel.span_hashes(data, starts, ends, kernel.ALNUM)
        self.hash, at, self.row = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (self.hash >> np.uint64(64 - 15)).astype(np.int64)
        self.gram, self.gram_start = _character_grams(data, starts[at], ends[at])


def gathered(texts: pa.ChunkedArray) -> Words:
    """The words of all texts, made from blocks of them."""
    parts = [Words(data, offsets) for chunk in texts.chunks for _, _, data, offsets in kernel.text_slices(chunk)]
    out = Words.__new__(Words)
    out.hash, at, row = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
    base, begun = (np.cumsum([0, *(len(x) for x in xs)]) for xs in ([p.hash for p in parts], [p.gram for p in parts]))
    out.row = np.concatenate([row[a : a + len(p.hash)].astype(np.int32)[p.row] for a, p in zip(base, parts, strict=False)])
    out.first = np.append(0, np.cumsum(np.concatenate([np.diff(p.first) for p in parts])))
    out.bucket = np.concatenate([p.bucket for p in parts])[at]
    sizes = np.concatenate([np.diff(np.append(p.gram_start, len(p.gram))) for p in parts])[at]
    start = np.concatenate([p.gram_start + a for a, p in zip(begun, parts, strict=False)])[at]
    out.gram_start = np.cumsum(sizes) - sizes
    out.gram = np.concatenate([p.gram for p in parts])[np.repeat(start - out.gram_start, sizes) + np.arange(int(sizes.sum()))]
    return out


def _character_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams (with a mark on either side) and prefixes of each word, and where each word's begin."""
    sizes = ends - starts  # a word of n bytes has n trigrams and all of PREFIXES, cut to its length
    begin = np.cumsum(sizes + len(PREFIXES)) - sizes - len(PREFIXES)
    out = np.empty(int((sizes + len(PREFIXES)).sum()), np.int64)
    inside = np.cumsum(sizes) - sizes
    at = np.repeat(starts - inside, sizes) + np.arange(int(sizes.sum()))
    folded = data.astype(np.int32)
    folded[(data >= 65) & (data <= 90)] += 32
    left, right = folded[at - 1], folded[np.minimum(at + 1, len(data) - 1)]
    left[inside] = 1
    right[inside + sizes - 1] = 2
    code = (left << 16 | folded[at] << 8 | right).astype(np.uint64)
    out[np.repeat(begin - inside, sizes) + np.arange(len(at))] = kernel.mix(code) >> np.uint64(64 - 14)
    for k, n in enumerate(PREFIXES):
        stop = np.minimum(ends, starts + n)
        out[begin + sizes + k] = kernel.span_hashes(data, starts, stop, kernel.ALNUM) >> np.uint64(64 - 14)
    return out, begin


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window, and the text it belongs to; a text has at least one."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    # The last window ends with the text.
    start = np.minimum(turn * STRIDE, np.maximum(0, n - WINDOW)[text])
    return first[:-1][text] + start, np.minimum(WINDOW, n[text] - start), text


# ---------------------------------------------------------------------------------------------- network


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        n = WORD_DIM + CHAR_DIM
        self.p = {"words": draw(WORDS, WORD_DIM, scale=0.05), "grams": draw(GRAMS, CHAR_DIM, scale=0.1), "attention": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": draw(n, 3 * HIDDEN, scale=0.3), f"u{way}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        out = np.empty((len(words.bucket), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["words"][words.bucket]
        bounds = np.append(words.gram_start, len(words.gram))
        for a in range(0, len(out), CHUNK):
            own = bounds[a : a + CHUNK + 1]
            sums = np.add.reduceat(self.p["grams"][words.gram[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
            out[a : a + CHUNK, WORD_DIM:] = sums / np.diff(own)[:, None]
        return out

    def _run(self, way: str, x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one layer over (steps, windows, 3 * HIDDEN) projected inputs."""
        steps, n, _ = x.shape
        states = np.zeros((steps, n, HIDDEN), np.float32)
        h, u, trail = np.zeros((n, HIDDEN), np.float32), self.p[f"u{way}"], []
        for t in range(steps) if way == "f" else reversed(range(steps)):
            gates = _gate(x[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            after = h + z * (new - h)
            after = np.where(keep[t][:, None], after, h)
            trail.append((t, h, z, r, new))
            states[t] = h = after
        return states, trail

    def forward(self, inputs: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows; at and keep are (steps, windows): rows of inputs, and which steps exist."""
        seen: dict = {}
        both = []
        for way in "fb":
            projected = inputs @ self.p[f"w{way}"] + self.p[f"c{way}"]
            states, seen[way] = self._run(way, projected[at], keep)
            both.append(states)
        h = np.concatenate(both, axis=2)
        score = np.where(keep, h @ self.p["attention"], np.float32(-1e4))
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, h)
        seen |= {"h": h, "share": share, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0], seen

    def backward(self, inputs: np.ndarray, at: np.ndarray, keep: np.ndarray, seen: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the inputs, for the slopes of the logits."""
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "grams")}
        h, share, pooled = seen["h"], seen["share"], seen["pooled"]
        g["out"], g["bias"] = pooled.T @ slope, slope.sum(keepdims=True)
        dpool = slope[:, None] * self.p["out"]
        dshare = np.einsum("nh,tnh->tn", dpool, h)
        dscore = share * (dshare - (share * dshare).sum(0)) * keep
        g["attention"] = np.einsum("tn,tnh->h", dscore, h)
        dh = share[:, :, None] * dpool + dscore[:, :, None] * self.p["attention"]
        dinputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            u, dx = self.p[f"u{way}"], np.zeros((*at.shape, 3 * HIDDEN), np.float32)
            carry = np.zeros((at.shape[1], HIDDEN), np.float32)
            for t, before, z, r, new in reversed(seen[way]):
                d = carry + dh[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = keep[t][:, None]
                dnew = d * z * (1 - new * new) * live
                drh = dnew @ u[:, 2 * HIDDEN :].T
                dz = d * (new - before) * 0.25 * ((z > 0) & (z < 1)) * live
                dr = drh * before * 0.25 * ((r > 0) & (r < 1)) * live
                dx[t] = np.concatenate([dz, dr, dnew], axis=1)
                g[f"u{way}"][:, : 2 * HIDDEN] += before.T @ dx[t][:, : 2 * HIDDEN]
                g[f"u{way}"][:, 2 * HIDDEN :] += (r * before).T @ dnew
                carry = np.where(live, d * (1 - z) + drh * r + dx[t][:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T, d)
            flat = dx.reshape(-1, 3 * HIDDEN)
            g[f"c{way}"] = flat.sum(0)
            g[f"w{way}"] = inputs[at.ravel()].T @ flat
            np.add.at(dinputs, at.ravel(), flat @ self.p[f"w{way}"].T)
        return g, dinputs

    def window_logits(self, words: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        inputs = self.inputs(words)
        inputs = np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
        rows = np.append(words.row, len(inputs) - 1)
        out = np.empty(len(starts), np.float32)
        for a in range(0, len(starts), CHUNK):
            at, keep = _steps(rows, starts[a : a + CHUNK], sizes[a : a + CHUNK])
            out[a : a + CHUNK] = self.forward(inputs, at, keep)[0]
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text: of its worst window."""
        words = Words(data, offsets)
        starts, sizes, text = windows(words.first)
        logits = self.window_logits(words, starts, sizes)
        worst = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(offsets) - 1)))
        return 1 / (1 + np.exp(-worst.astype(float)))


def _steps(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    keep = t < sizes[None, :]
    return rows[np.where(keep, starts[None, :] + t, len(rows) - 1)], keep


# --------------------------------------------------------------------------------------------- learning


def train(words: Words, toxic: np.ndarray, seed: int = 1) -> Network:
    """Fit a network to the words of documents and their labels."""
    net = Network(seed)
    starts, sizes, text = windows(words.first)
    # Log-odds of word and gram buckets over documents, damped for rare ones.
    odds, gram_odds = _odds(words, toxic)
    net.p["words"][:, 0], net.p["grams"][:, 0] = odds, gram_odds
    best = np.maximum.reduceat(gram_odds[words.gram], words.gram_start)
    of_word = np.append((odds[words.bucket] + best)[words.row], 0)
    total = np.concatenate([[0], np.cumsum(np.maximum(of_word, 0))])
    rank = total[starts + sizes] - total[starts]
    first = np.searchsorted(text, np.arange(len(toxic)))
    rng = np.random.default_rng(seed)
    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps = 0
    for turn in range(ROUNDS):
        if turn:
            rank = net.window_logits(words, starts, sizes)
        worst = np.array([a + np.argmax(rank[a:b]) for a, b in zip(first, np.append(first[1:], len(starts)), strict=True)])
        other = first + (rng.random(len(first)) * np.diff(np.append(first, len(starts)))).astype(np.int64)
        chosen = np.concatenate([worst, other[toxic == 0]])
        wanted = np.concatenate([toxic, np.zeros((toxic == 0).sum(), toxic.dtype)]).astype(np.float32)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(chosen)))):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), BATCH):
                part = chosen[order[a : a + BATCH]]
                steps += 1
                _step(net, words, starts[part], sizes[part], wanted[order[a : a + BATCH]], adam, steps)
    return net


def _odds(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of word and gram buckets, by how many documents of either class have them (a few at a time)."""
    seen = {n: np.zeros((2, n)) for n in (WORDS, GRAMS)}
    bounds = np.append(words.gram_start, len(words.gram))
    for doc, label in enumerate(toxic.tolist()):
        rows = np.unique(words.row[words.first[doc] : words.first[doc + 1]])
        sizes = bounds[rows + 1] - bounds[rows]
        at = np.repeat(bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        seen[WORDS][label, np.unique(words.bucket[rows])] += 1
        seen[GRAMS][label, np.unique(words.gram[at])] += 1
    damp, n = 8.0 / len(toxic), np.maximum(np.bincount(toxic, minlength=2), 1)[:, None]
    return tuple(np.log((x[1] + damp) / (x[0] + damp)).astype(np.float32) for x in (seen[WORDS] / n, seen[GRAMS] / n))


def _step(net: Network, words: Words, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, adam: dict, turn: int) -> None:
    at, keep = _steps(np.append(words.row, len(words.bucket)), starts, sizes)
    used, at = np.unique(at, return_inverse=True)
    at = at.reshape(keep.shape)
    some = used[used < len(words.bucket)]
    stop = np.append(words.gram_start[1:], len(words.gram))
    part = Words.__new__(Words)
    part.bucket = words.bucket[some]
    lengths = stop[some] - words.gram_start[some]
    part.gram_start = np.cumsum(lengths) - lengths
    part.gram = words.gram[np.repeat(words.gram_start[some] - part.gram_start, lengths) + np.arange(int(lengths.sum()))]
    inputs = np.concatenate([net.inputs(part), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
    logits, seen = net.forward(inputs, at, keep)
    slope = ((1 / (1 + np.exp(-logits)) - wanted) / len(wanted)).astype(np.float32)
    g, dinputs = net.backward(inputs, at, keep, seen, slope)
    dinputs = dinputs[: len(some)]
    g["words"], g["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
    np.add.at(g["words"], part.bucket, dinputs[:, :WORD_DIM])
    np.add.at(g["grams"], part.gram, np.repeat(dinputs[:, WORD_DIM:] / np.maximum(lengths, 1)[:, None], lengths, axis=0))
    for k, v in net.p.items():
        m, s = adam[k]
        m += 0.1 * (g[k] - m)
        s += 0.001 * (g[k] * g[k] - s)
        v -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network from a bounded sample of labelled documents; None without both classes."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    turn = F.xxhash64("doc_id", F.lit(77))
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(turn, "doc_id").limit(DOCS)
        picked = part if picked is None else picked.unionByName(part)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    # Rows that repeat an id: one text of each id and label, so the sample stays within its bound.
    one = named.join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = one.orderBy("doc_id", "label").select("label", "text").toArrow()
    toxic = rows["label"].to_numpy().astype(np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    words = gathered(rows["text"])
    del rows
    kernel.release()
    return train(words, toxic)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @kernel.tidy
    def judge(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, b, data, offsets in kernel.text_slices(batch.column(1), 1 << 20):
                found = shared.value.scores(data, offsets) if shared.value else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), pa.array((found >= TOXIC).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, SCHEMA)
