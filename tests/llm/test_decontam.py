import hashlib
import random
import re

from quarrylake.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["ab", "c", "été", "Zz", "9x", "the", "of", "straße", "k"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, say(n)) for i, n in enumerate([40, 25, 10, 9, 5, 30])] + [(6, None), (7, ""), (8, "!!"), (9, "lone-word"), (10, "solo")]
    bench.append((11, bench[0][1]))
    docs = [(i, say(rng.choice([0, 3, 9, 10, 11, 60, 400]))) for i in range(60)]
    for i in range(60, 90):
        item = words(bench[rng.choice([0, 1, 2, 5])][1])
        a = rng.randrange(max(1, len(item) - 9))
        docs.append((i, f"{say(rng.randrange(30))} {', '.join(item[a : a + rng.choice([8, 9, 10, 11, 15])]).upper()}. {say(20)}"))
    docs += [(90, None), (91, ""), (92, "..."), (93, "Solo act"), (94, "a LONE word here"), (95, bench[0][1] * 2)]
    return docs, bench


def check(spark, index_words):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, b, index_words=index_words).collect()}
    assert got == brute(docs, bench)


def test_broadcast_index_matches_brute_force(spark):
    check(spark, 1_000_000)


def test_many_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 6)
    check(spark, 90)


def test_rows_are_dropped_one_by_one(spark, monkeypatch):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k l"), (2, "seven words are too few for it")] + [(3 + i, f"only{i} three words") for i in range(30)], "item_id long, text string")
    dirty, short = "x a b c d e f g h i j k l y", "so seven words are too few for it then"
    rows = [(7, "clean as can be", 1), (7, dirty, 2), (None, dirty, 3), (None, "clean", 4), (8, short, 5), (8, None, 6), (9, "say only17 THREE words", 7), (9, "x " * 20_000 + dirty, 8), (7, "clean as can be", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    for size in (1_000_000, 20):
        kept = decontam.drop_contaminated(docs, bench, index_words=size)
        assert kept.columns == docs.columns
        assert sorted(r.row for r in kept.collect()) == [1, 1, 4, 6]
        found = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontam.contamination(docs, bench, index_words=size).collect()}
        assert found[7, 14] == (12, 1) and found[9, 4] == (3, 1) and found[9, 20_014] == (12, 1) and found[None, 1] == (0, 0)


def test_words_alike_by_hash_are_no_hit(spark):
    from .test_kernel import twins

    one, two = twins()
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(docs, bench).collect()} == {1: 1, 2: 0}


def test_windows_alike_by_hash_are_no_hit(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quarrylake.llm import kernel

    monkeypatch.setattr(kernel, "span_hashes", lambda data, starts, ends, *_: np.full(len(starts), 5, np.uint64))
    index = decontam.Index([("1", "a b c"), ("2", " ".join("abcdefghijkl"))])
    hits = lambda text: index.hits(*kernel.string_buffers(pa.array([text])))[1].sum()
    assert hits("x y z a b c") == 3 and hits(" ".join("zyxwvutsrqponm")) == 0 and hits(" ".join("zabcdefghijklz")) == 12


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.n_words, r.contaminated) for r in decontam.contamination(one, b).collect()) == [(1, False), (2, False)]
