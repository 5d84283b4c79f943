import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quarrylake.llm import mixing


def rows(n=400, seed=4):
    rng = random.Random(seed)
    out = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["b", "b", "b", "b", "a", "ü", None])) for i in range(n)]
    out += [(n, None, "b"), (n + 1, "one two", "tiny"), (n + 2, "", "empty"), (None, "x y z", "b"), (5, "x y", "b"), (5, "x y", "b")]
    return out


def test_matches_sql_and_targets(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in data], "doc_id long, text string, source string, idx long, size long").repartition(5)
    got = mixing.mixture(df).toPandas()
    con = duckdb.connect()
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    want = con.sql(mixing.SQL).df()
    order = ["doc_id", "size", "taken", "target", "parts"]
    norm = lambda x: x.astype({"doc_id": "float"}).sort_values(order).reset_index(drop=True)[[*order, "source_size"]]
    pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False)
    assert (got.taken <= 3 * got["size"]).all()
    taken = got.groupby(["target", "source_size"]).agg({"taken": "sum"})
    assert len(taken) == 6 and all(abs(r.taken - t) <= 1 for (t, _), r in taken.iterrows())
    assert abs(got.taken.sum() - got["size"].sum()) <= 5


def test_schedule_is_spread_evenly(spark):
    sources = spark.createDataFrame([(0, 500), (1, 250), (2, 10), (3, 0)], "idx long, quota long")
    plan = mixing.schedule(sources, 1).orderBy("slot").toPandas()
    assert plan.groupby("idx").size().to_dict() == {0: 500, 1: 250, 2: 10}
    assert plan.groupby("idx")["rank"].nunique().to_dict() == {0: 500, 1: 250, 2: 10}
    half = plan[plan.slot < 380].groupby("idx").size()
    assert abs(half[0] - 250) < 6 and abs(half[1] - 125) < 6


def test_any_prefix_of_slots_is_balanced(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    parts = mixing.mixed(df, slots=600).where("slot IS NOT NULL").toPandas()
    quota = parts.groupby("idx").words.sum()
    block = -(-int(quota.sum()) // 600)
    n = -(-quota // block)
    for upto in (60, 200, 400, int(n.sum())):
        got = parts[parts.slot < upto].groupby("idx").words.sum().reindex(quota.index, fill_value=0)
        assert (abs(got - quota * upto / n.sum()) <= 5 * block).all(), upto
    assert parts.groupby("slot").words.sum().max() <= block


def test_texts_of_the_mix(spark):
    data = [(i, "" if i == 3 else " ".join(f"w{i}x{k}" for k in range(1 + i % 7 * 9)) + " \n", "s" if i % 3 else None, i) for i in range(60)]
    data.append((None, "a b c", "s", 7))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, row long").repartition(4)
    want = {}
    for r in mixing.mixture(df, slots=40).collect():
        for part in filter(None, r.parts.split(",")):
            slot, at, n = map(int, part.split(":"))
            want[slot, r.doc_id, at] = n
    out = mixing.mixed_texts(df, slots=40)
    assert out.columns == df.columns
    got = out.collect()
    texts = {(i, s): t for i, t, s, _ in data}
    order = sorted(want, key=lambda k: (k[0], k[2], k[1] is None, k[1] or 0))
    cut = [(i, texts[i, None if i is not None and i % 3 == 0 else "s"].split()[at : at + want[slot, i, at]]) for slot, i, at in order]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.text.split()) for r in got), key=key) == sorted(cut, key=key)
    slots_of = {}
    for slot, i, at in want:
        slots_of.setdefault((i, tuple(texts[i, None if i is not None and i % 3 == 0 else "s"].split()[at : at + want[slot, i, at]])), set()).add(slot)
    last = -1
    for r in got:  # rows come by slot
        last = min(s for s in slots_of[r.doc_id, tuple(r.text.split())] if s >= last)
    whole = [r for r in got if r.doc_id == 1]
    assert {r.text for r in whole} <= {data[1][1]} | {r.text for r in whole if len(r.text) < len(data[1][1])}


def test_empty(spark):
    df = spark.createDataFrame(rows(60), "doc_id long, text string, source string")
    assert mixing.mixture(df.limit(0)).count() == 0 == mixing.mixed_texts(df.limit(0)).count()
    assert mixing.mixture(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_null_ids_and_clashing_names(spark):
    data = [(None, "a b c", "s", 1, 2), (None, "d e", None, 3, 4), (1, "f g", "s", 5, 6), (2, "", "s", 7, 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot long, doc long")
    out = mixing.mixed_texts(df).collect()
    taken = mixing.mixture(df).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in out) == taken == 7
    assert (None, 3, 4) in {(r.doc_id, r.slot, r.doc) for r in out} <= {(None, 1, 2), (None, 3, 4), (1, 5, 6)}
