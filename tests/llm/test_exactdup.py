import hashlib
import random
from collections import defaultdict

from quarrylake.llm import exactdup
from quarrylake.llm.common import Scratch
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, row int").repartition(5)
    return sorted(str(tuple(r)) for r in exactdup.exact_duplicates(df, **how).collect())


def corpus(n=800, seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, "a", "A", "é", "é", " a", "long " * 5000]) if rng.random() < 0.3 else f"text {rng.randrange(2 * n)}") for i in range(n)]
    rows += [(n + i, "hot") for i in range(n // 3)] + [(7, "again")] * 3 + [(None, "no id"), (None, "no id"), (None, "text 1"), (5, "hot")]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    assert run(spark, corpus()) == brute(corpus())


def test_many_rounds_and_a_full_filter(spark, monkeypatch):
    rows = corpus(3000, 6)
    assert run(spark, rows, filter_bytes=1) == brute(rows)
    monkeypatch.setattr(exactdup, "filter_words", lambda rows: 1 << 12)
    monkeypatch.setattr(exactdup, "HOT", 3)  # groups of less than a third go by shuffle
    rows = corpus(9000, 7)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_few_unique_rows_are_shuffled(spark):
    n = 20_000
    rows = spark.range(n).select(F.xxhash64(F.col("id") % (n - 2000)).alias("fingerprint"))
    words = exactdup.filter_words(n)
    kept = Scratch(spark).keep(exactdup.repeated_counters(rows, words), "counters").collect()
    bits = {r.slot: r.set & (1 << 64) - 1 for r in kept}
    maybe = defaultdict(int)
    for r in rows.collect():
        f = r.fingerprint & (1 << 64) - 1
        word = f & words - 1
        value = bits.get(word >> 2, 0)
        if all(value >> (4 * (f >> s & 15) + word % 4) & 1 for s in (56, 60)):
            maybe[f] += 1
    assert sum(k == 2 for k in maybe.values()) == 2000  # every repeated row is found
    assert sum(k == 1 for k in maybe.values()) < 0.02 * n
