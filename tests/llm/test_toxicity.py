import random

import numpy as np
import pyarrow as pa

from quarrylake.llm import kernel, toxicity

BAD = ["idiot", "scum", "moron", "trash"]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 20, 80]))]
        if i % 2:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        out.append((i, " ".join(words), i % 2))
    return out


def test_gradients_match_differences():
    net = toxicity.Network(2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    inputs = rng.normal(0, 0.5, (9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    at, keep = rng.integers(0, 9, (toxicity.WINDOW, 4)), np.arange(toxicity.WINDOW)[:, None] < np.array([16, 3, 1, 9])
    slope = rng.normal(size=4)
    loss = lambda: float(net.forward(inputs, at, keep)[0] @ slope)
    g, dinputs = net.backward(inputs, at, keep, net.forward(inputs, at, keep)[1], slope)
    for where, grad in [*((net.p[k], g[k]) for k in g), (inputs, dinputs)]:
        for i in rng.integers(0, where.size, 5):
            old = where.flat[i]
            where.flat[i] = old + 1e-4
            up = loss()
            where.flat[i] = old - 1e-4
            down = loss()
            where.flat[i] = old
            assert abs((up - down) / 2e-4 - grad.flat[i]) < 2e-3 * max(1, abs(grad.flat[i]))


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 21, 60, 60])
    starts, sizes, text = toxicity.windows(first)
    for i in range(5):
        own = text == i
        assert own.any()
        covered = {w for a, n in zip(starts[own], sizes[own], strict=True) for w in range(a, a + n)}
        assert covered == set(range(first[i], first[i + 1]))


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None)], "doc_id long, toxic int")
    net = toxicity.learn(df, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "du scum idiot"), (5, "la " * 40_000 + "idiot scum moron " + "la " * 40_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(odd, net).collect()}
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found.values()) and found[1].score == found[2].score == found[3].score
    assert found[5].predicted == 1
    assert toxicity.score(odd.limit(0), net).count() == 0
    assert toxicity.learn(df, labels.where("toxic = 0")) is None and toxicity.score(odd, None).agg({"score": "max"}).first()[0] == 0


def test_scores_do_not_depend_on_neighbours():
    net = toxicity.Network(5)
    texts = [t for _, t, _ in corpus(30)]
    data, offsets = kernel.string_buffers(pa.array(texts))
    alone = [net.scores(*kernel.string_buffers(pa.array([t])))[0] for t in texts]
    assert np.allclose(net.scores(data, offsets), alone, atol=1e-5)


def test_learns_from_all_words_of_long_texts(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "train", lambda words, toxic: held.append((words, toxic)))
    df = spark.createDataFrame([(1, "la " * 2500 + "idiot scum " + "la " * 2500), (2, "so " * 4000), (3, None)], "doc_id long, text string")
    toxicity.learn(df, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"))
    (words, toxic), = held
    assert np.diff(words.first).tolist() == [5002, 4000] and toxic.tolist() == [1, 0]


def test_blocks_give_the_words_of_the_whole():
    texts = [t for _, t, _ in corpus(60)] + ["", "du du"]
    whole = toxicity.Words(*kernel.string_buffers(pa.array(texts)))
    got = toxicity.gathered(pa.chunked_array([texts[:7], texts[7:8], texts[8:40], texts[40:]]))
    for name in ("hash", "row", "first", "bucket", "gram", "gram_start"):
        assert np.array_equal(getattr(got, name), getattr(whole, name)), name
