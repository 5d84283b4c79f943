import random
import re

import numpy as np
import pyarrow as pa

from quarrylake.llm import kernel, neardup


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(n=150, seed=5):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyzé") + rng.choice("aeiou") + rng.choice("XYZ") for _ in range(k)]
    docs = [(i, " ".join(say(rng.choice([1, 2, 3, 4, 5, 30, 90, 300])))) for i in range(n)]
    for base in (say(120), say(400)):
        for i in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                words[rng.randrange(len(words))] = "q" + str(rng.random())
            docs.append((len(docs), " ".join(words)))
    chain = say(200)
    for i in range(25):  # each near the next, the ends far apart
        docs.append((len(docs), "\n".join(chain[i * 4 : i * 4 + 100])))
    docs += [(len(docs) + i, t) for i, t in enumerate([None, "", "  \n", docs[3][1], docs[3][1].upper(), "a", "A", "a b", "one two three", "x " * 3000])]
    rng.shuffle(docs)
    return docs


def run(spark, docs, k):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, a long, key string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, shingle=k).collect()}


def test_matches_brute_force(spark):
    docs = corpus()
    assert run(spark, docs, 4) == brute(docs, 4)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b  c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in neardup.drop_near_duplicates(odd).collect()) == [0, 1, 1]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        both = int(n * 2 * share / (1 + share))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = kernel.mix(pool[:n]), kernel.mix(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        ra, rb, rab = (neardup.registers(x, np.array([0, len(x)])) for x in (a, b, np.concatenate([a, b])))
        assert (neardup.merge(ra, rb) == rab).all()
        likely = neardup.likely_jaccard(ra, rb, np.array([n]), np.array([n]))[0]
        assert abs(likely - share) < 0.1
        for least in (likely - 0.03, likely + 0.03):
            assert neardup.reaches(ra, rb, np.array([n]), np.array([n]), least)[0] == (least < likely)


def test_short_texts_have_one_shingle():
    data, offsets = kernel.string_buffers(pa.array(["", "a", "a b", "a b c d e", "b"]))
    assert np.diff(neardup.shingle_hashes(data, offsets, 4)[1]).tolist() == [0, 1, 1, 2, 1]


def test_words_alike_by_hash_are_not_linked(spark, monkeypatch):
    from .test_kernel import twins

    assert run(spark, list(enumerate(twins())), 4) == {0: (1, 0, True), 1: (1, 1, True)}
    monkeypatch.setattr(kernel, "span_hashes", lambda data, starts, ends, *_: np.full(len(starts), 7, np.uint64))
    one, two = (neardup._Shingled(pa.scalar(x), 4) for x in ("a b c d e", "a b c d f"))
    assert len(one.set) == len(two.set) == 1 and not one.common(neardup._Shingled(pa.scalar("w x y z"), 4))
    assert neardup.linked(one, neardup._Shingled(pa.scalar("A b  c d"), 4))


def test_undecided_buckets_of_many_blocks(spark, monkeypatch):
    docs = corpus(4, 12)[:70]
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 12)
    monkeypatch.setattr(neardup, "_likeliest", lambda pairs, n: pairs.select("a", "b").where("a < 0"))  # no pair is tested before
    assert run(spark, docs, 4) == brute(docs, 4)
