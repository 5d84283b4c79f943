"""One small test for each finding of the second review that held: inputs on which the queries were wrong or grew."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylake.operators import agent, chunking, cluster, dedup, quality, retrieval
from quarrylake.plans import catalog
from quarrylake.sources import html
from tests.test_entry import comparable


@pytest.fixture
def matches(spark, tmp_path):
    """Whether a query over small tables (made here as frames) gives what its SQL gives."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, frame in tables.items():
            frame.to_parquet(f"{tmp_path}/{t}.parquet", index=False)
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
        assert len(want) > 0
        assert comparable(got[list(want.columns)]) == comparable(want)

    return check


def test_page_rules_take_no_words_of_the_urls(matches):
    urls = ["https://a.example/en/5007?page=2", "http://m.example/gift/5005", "https://vf9.example/tin-tuc", None]
    matches("page_rules", pages=pd.DataFrame({"page_id": range(1, 13), "url": urls * 3}))


def test_query_rules_end_words_at_ascii_letters_only(matches):
    texts = ["Doesí ciciñ", "La que isñ", "plain", "the end", "wörld"]
    matches("query_rules", conversations=pd.DataFrame([(c, t, texts[(c + t) % 5]) for c in range(24) for t in range(5)], columns=["conv_id", "turn", "text"]))


def test_results_of_new_runs_are_new_in_tables_with_thousands_of_runs(matches):
    rows = pd.DataFrame([(q, run) for q in range(1, 40) for run in (7, 1007, 2007)], columns=["l_orderkey", "l_suppkey"])
    rows = rows.assign(l_discount=0.1, l_shipdate=pd.Timestamp("2024-01-01"), l_returnflag=["R" if (q + r) % 4 == 0 else "N" for q, r in zip(rows.l_orderkey, rows.l_suppkey, strict=True)])
    matches("result_upsert", lineitem=rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_are_never_broadcast_with_their_keys(spark):
    prints = spark.range(50).selectExpr("id AS chunk_id", "id AS pos", "id * 1000003 AS print")
    met = dedup.print_pairs(prints, prints)
    assert "SortMergeJoin" in plan(met) and "BroadcastHashJoin" not in plan(met)


@pytest.mark.parametrize("distance", (0, 3, 6, 9))
def test_fingerprint_pairs_are_all_found_once(spark, distance):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    made = [(i, i, sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) ^ base[i % 12]) for i in range(150)]
    signed = [(i, p, v - (1 << 64) if v >> 63 else v) for i, p, v in made]
    df = spark.createDataFrame(signed, "chunk_id long, pos long, print long")
    got = sorted((r.l_id, r.r_id, r.distance) for r in dedup.print_pairs(df, df, distance).collect())
    assert got == sorted((a, b, d) for a, _, x in made for b, _, y in made if a < b and (d := (x ^ y).bit_count()) <= distance)


def test_texts_reach_python_in_bounded_batches(spark, monkeypatch):
    seen = []
    inner = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, what, rows=None: seen.append((what, rows)) or inner(df, what, rows))
    chunks = spark.createDataFrame([(i, i, "é same words here" if i < 3 else f"é other {i}") for i in range(9)], "chunk_id long, pos long, text string")
    assert dedup.counters(dedup.exact_matches(chunks)).first().n == 2
    assert dedup.incremental(chunks.where("pos < 2"), chunks.where("pos >= 2")).count() >= 1
    assert all(rows == cluster.TEXTS for what, rows in seen if what in ("keys", "prints")) and {"keys", "prints"} <= {what for what, _ in seen}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with cluster.arrow_rows(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def vectors(spark, n, size=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, size)).astype(np.float32))]
    return spark.createDataFrame(rows, "chunk_id long, pos long, embedding array<float>"), np.array([r[2] for r in rows])


def test_blocks_of_vectors_meet_each_other_and_themselves_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    df, v = vectors(spark, 300)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.round(unit @ unit.T, 6) >= 0.4), strict=True) if i < j}
    # Rows arrive in another order each time that Spark makes them.
    shaken = df.repartition(7).orderBy(F.rand())
    got = [(r.canonical_id, r.duplicate_id) for r in dedup.embedding_matches(shaken, 0.4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_meetings_of_blocks_reach_python_one_at_a_time(spark, monkeypatch):
    seen = []
    for module in (dedup, retrieval):
        monkeypatch.setattr(module, "written", lambda df, what, rows=None, inner=module.written: seen.append((what, rows, plan(df))) or inner(df, what, rows))
    df, _ = vectors(spark, 60)
    dedup.embedding_matches(df, 0.4).count()
    retrieval.dense(df, df.withColumnRenamed("chunk_id", "query_id"), 3, sent=10).count()
    assert [(what, rows) for what, rows, _ in seen] == [("pairs", 1), ("hits", 1)]
    assert not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for _, _, p in seen)


def test_large_cells_of_vectors_are_cut_and_keep_their_pairs(spark, monkeypatch):
    df, v = vectors(spark, 90, 4)
    close = df.unionByName(df.selectExpr("chunk_id + 1000 AS chunk_id", "pos + 1000 AS pos", "transform(embedding, (x, i) -> float(x + 0.01 * i)) AS embedding"))
    pairs = lambda: sorted((r.canonical_id, r.duplicate_id, r.score) for r in dedup.embedding_cell_matches(close, 0.9, per_cell=60).collect())
    whole = pairs()
    exact = {(r.canonical_id, r.duplicate_id) for r in dedup.embedding_matches(close, 0.9).collect()}
    monkeypatch.setattr(dedup, "LARGE_BLOCK", 16)
    assert pairs() == whole and len(whole) == len(set(whole)) and {x[:2] for x in whole} <= exact and len(whole) >= 0.9 * len(exact)


def test_nearest_elsewhere_keeps_no_more_hits_for_large_documents(spark, monkeypatch):
    asked_for = []
    dense = retrieval.dense
    monkeypatch.setattr(retrieval, "dense", lambda c, q, k=10, *a, **b: asked_for.append(k) or dense(c, q, k, *a, **b))
    df, v = vectors(spark, 200)
    held = df.withColumn("document_id", F.when(F.col("chunk_id") % 10 < 9, "large").otherwise(F.col("chunk_id").cast("string")))
    got = sorted((r.query_id, r.chunk_id) for r in dedup.nearest_elsewhere(held, held.where("chunk_id % 20 = 3"), -1.0, 3).collect())
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    other = [c for c in range(200) if c % 10 == 9]
    want = sorted((q, c) for q in range(3, 200, 20) for c in sorted(other, key=lambda c: (-round(float(unit[q] @ unit[c]), 6), c))[:3])
    assert got == want and asked_for == [3]


def test_chunks_that_say_the_same_are_compared_once(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(quality, "written", lambda df, what, rows=None, inner=quality.written: held.setdefault(what, inner(df, what, rows)))
    texts = ["the vf 8 range is long", "the vf 8 range is short", "the vf 8 is long and short", "plain words"]
    rows = [(i, texts[i * 7 % 4]) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    got = [(r.left_id, r.right_id, r.score) for r in quality.candidate_pairs(chunks, 30).collect()]
    words = {i: set(t.split()) for i, t in rows}
    plain = lambda i: "vf" in words[i]
    score = lambda a, b: round(len(words[a] & words[b]) / len(words[a] | words[b]), 6)
    want = sorted((-score(a, b), a, b) for a in words for b in words if a < b and plain(a) == plain(b) and score(a, b) >= 0.35)[:30]
    assert got == [(a, b, -s) for s, a, b in want]
    assert held["candidates"].count() == 4 and held["candidates"].agg(F.max(F.size("ids"))).first()[0] == 31


def test_large_groups_of_claims_are_spread_and_every_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART_ROWS", 8)
    rows = [(i, "e" if i % 5 else "f", "a", str(i % 3), "1", None, [str(i - 1)]) for i in range(60)]
    claims = spark.createDataFrame(rows, "chunk_id long, entity string, attribute string, value string, version string, effective_date string, supersedes array<string>")
    left, _ = quality.met_in_parts(claims, ["entity"])
    assert left.groupBy("entity", "part").count().agg(F.max("count")).first()[0] <= 24
    got = sorted((r.left_id, r.right_id) for r in quality.claim_conflicts(claims).collect())
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] != b[3] and a[0] != b[0] - 1]


def test_pairs_of_lone_facts_are_not_grouped_and_others_are_one(spark):
    rows = [(1, "car x", "price", "usd", 10.0, "the price of it", 0), (1, "car y", "price", "usd", 11.0, "the price of it", 5), (2, "car x", "price", "usd", 90.0, "the price of it", 0), (2, "car y", "price", "usd", 80.0, "the price of it", 5), (3, "car x", "price", "usd", 50.0, "the price of it", 0), (4, "car x", "price", "usd", 70.0, "the price of it", 0)]
    found = spark.createDataFrame(rows, "chunk_id long, entity string, attribute string, unit string, norm double, span string, start int")
    got = sorted((r.left_id, r.right_id, r.entity, r.left_value, r.right_value) for r in quality.scanned_conflicts(found).collect())
    assert got == [(1, 2, "car x", 10.0, 90.0), (1, 3, "car x", 10.0, 50.0), (1, 4, "car x", 10.0, 70.0), (2, 3, "car x", 90.0, 50.0), (2, 4, "car x", 90.0, 70.0), (3, 4, "car x", 50.0, 70.0)]


def test_chunkers_and_page_parsing_take_a_few_rows_of_a_batch_at_a_time(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"# Title {i}\n\nbody {i}\n\n" * 3 if i % 7 else None) for i in range(500)], "doc_id long, text string").coalesce(1)

    def sizes(ids, texts):
        return [(len(ids),)]

    assert max(r.n for r in cluster.by_slices(docs.select("doc_id", "text"), sizes, "n int").collect()) == cluster.SLICE
    got = [(r.doc_id, r.idx, r.chunk) for r in chunking.packed(docs).collect()]
    assert got == [(i, k, c) for i, t in docs.collect() for k, c in enumerate(chunking.packed_of(t or ""))]
    pages = spark.createDataFrame([(i, f"<html><head><meta name='a' content='{i}'></head><h1>T</h1><p>x</p></html>" if i % 9 else None) for i in range(200)], "page_id long, html string").coalesce(1)
    out = html.parsed(pages).collect()
    assert len(out) == 200 and all(r.meta in (None, {}) or r.meta["a"] == str(r.page_id) for r in out) and any(r.meta for r in out)


def test_near_duplicates_travel_as_hashes_and_are_all_found(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(quality, "written", lambda df, what, rows=None, inner=quality.written: held.setdefault(what, inner(df, what, rows)))
    monkeypatch.setattr(quality, "FREQUENT", 40, raising=False)
    rng = random.Random(2)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.08 else f"w{rng.randrange(30)}" for w in base[i % 12]) for i in range(120)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = sorted((r.left_id, r.right_id, r.score) for r in quality.near_duplicates(chunks).collect())
    sets = {t: i for i, t in reversed(list(enumerate(texts)))}
    grams = {i: {" ".join(p) for p in zip(w, w[1:], strict=False)} or set(w) for t, i in sets.items() for w in (t.split(),)}
    score = lambda a, b: round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6)
    assert got == sorted((a, b, score(a, b)) for a in grams for b in grams if a < b and score(a, b) >= 0.55) and len(got) > 50
    assert dict(held["shingles"].dtypes)["grams"] == "array<bigint>"


def test_term_frequencies_do_not_shuffle_the_words_of_each_document(spark, matches, tmp_path):
    texts = ["one two two"] * 15 + ["two three", None, ""] * 5
    matches("term_frequency", documents=pd.DataFrame({"doc_id": [*range(29), None], "text": texts}).astype({"doc_id": "Int64"}))
    assert plan(catalog.queries()["term_frequency"](spark, str(tmp_path))).count("Exchange") == 1
    matches("term_frequency", documents=pd.DataFrame({"doc_id": [i // 2 for i in range(30)], "text": texts}))


_CLUSTER = """
import sys, tempfile
from pyspark.sql import SparkSession
from quarrylake.sources import store
w = tempfile.mkdtemp()
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{w}").config("spark.local.dir", w).getOrCreate()
rows = [("a", 'say "x", y', 1), ("b", "two\\nlines", 2), ("c", None, 3), ("d", "", 4), ("e", "far", 9)]
with store.embedded() as (url, driver):
    for mode in ("overwrite", "overwrite", "append"):
        store.write_jdbc(spark.createDataFrame(rows, "id string, said string, n int").repartition(3), url, "held", mode, driver, "id VARCHAR(20), said VARCHAR(200)")
    found = store.read_jdbc(spark, url, 'SELECT * FROM held WHERE "n" < 5', driver)
    none = store.read_jdbc(spark, url, 'SELECT * FROM held WHERE "n" > 50', driver)
assert sorted(map(str, found.collect())) == sorted(str(spark.createDataFrame([r], found.schema).first()) for r in rows[:4] * 2) and found.schema["n"].dataType.typeName() == "integer"
assert none.count() == 0
"""


def test_embedded_store_on_executors_that_are_other_processes(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", _CLUSTER], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_store_relational_rows(matches):
    texts = ["short", None, "", 'with "marks"', "longer text"]
    matches("store_relational", documents=pd.DataFrame({"doc_id": range(60), "text": texts * 12, "source": ["src1", "src2", None] * 20, "lang": "en"}))


def _word_tables(ids):
    words = ["the", "Éclair", "éclair", "úber", "über", "x_1", "٣", "red", "blue", "𝒳𝒴", "ông"]
    texts = [" ".join(words[(i * j + j) % 11] for j in range(i % 13)) or None for i in range(len(ids))]
    asked = ["the red the", "ECLAIR blue", "Ong x_1", None, "", "nothing", "𝒳𝒴 ٣ uber"]
    return {"documents": pd.DataFrame({"doc_id": ids, "text": texts}).astype({"doc_id": "Int64"}), "benchmark": pd.DataFrame({"item_id": range(7), "text": asked})}


def test_bm25_takes_the_mean_length_of_texts_that_are_there(matches):
    matches("bm25_top10", **_word_tables(range(90)))


def test_term_scores_of_equal_and_missing_ids_are_put_together(matches):
    matches("sparse_top10", **_word_tables([*range(60), *range(50, 70), None, None]))


@pytest.mark.parametrize("channel", ["bm25", "sparse"])
def test_chunks_are_scored_where_they_lie_and_only_the_best_are_shuffled(spark, monkeypatch, channel):
    held = []
    monkeypatch.setattr(retrieval, "ranked", lambda df, *a, inner=retrieval.ranked: held.append(df) or inner(df, *a))
    monkeypatch.setattr(retrieval, "SENT", 2)
    monkeypatch.setattr(retrieval, "SCORED_CHUNKS", 7)
    chunks = spark.createDataFrame([(i, f"some words w{i % 7} w{i % 5} of text") for i in range(200)], "chunk_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(f"q{i}", f"words w{i} w{i + 2} text") for i in range(5)], "query_id string, text string")
    got = getattr(retrieval, channel)(chunks, asked, 3).collect()
    assert len(got) == 15 and held[0].count() <= 15 * 4
    if channel == "sparse":
        count = lambda q, i: sum(f"some words w{i % 7} w{i % 5} of text".split().count(w) for w in f"words w{q} w{q + 2} text".split())
        best = {q: sorted((-count(q, i), i) for i in range(200))[:3] for q in range(5)}
        assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got) == sorted((f"q{q}", i, float(-n), k + 1) for q, b in best.items() for k, (n, i) in enumerate(b))


def test_staged_files_are_as_many_as_the_splits_of_the_input(spark, tmp_path):
    from quarrylake.plans import q_warehouse

    rows = spark.range(3000).repartition(12)
    root, source = q_warehouse._staged_files(spark, str(tmp_path), rows, 2)
    files = spark.read.parquet(f"{root}/in")
    assert len(files.inputFiles()) == 12 and files.count() == 3000
    turns = []
    source.writeStream.foreachBatch(lambda batch, n: turns.append(batch.count())).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert len(turns) == 2 and sum(turns) == 3000


def test_answers_do_not_shuffle_texts_that_no_question_found(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "chunk_id long, text string")
    hits = spark.createDataFrame([(1, 7), (1, 9), (2, 9)], "query_id long, chunk_id long")
    assert sorted(map(tuple, agent.texts_of(hits, texts).collect())) == [(7, "text 7"), (9, "text 9")]


def test_keys_of_texts_need_no_python(spark, monkeypatch):
    held = []
    monkeypatch.setattr(dedup, "written", lambda df, *a, inner=dedup.written: held.append(df) or inner(df, *a))
    texts = spark.createDataFrame([(1, 1, "STRASSE ﬁ"), (2, 2, "straße　ﬁ"), (3, 3, None), (4, 4, "other")], "chunk_id long, pos long, text string")
    found = dedup.exact_matches(texts).select("canonical_id", "duplicate_id").collect()
    dedup.incremental_exact(texts, texts)
    assert [tuple(r) for r in found] == [(1, 2)]
    assert len(held) == 2 and not any("Python" in plan(df) for df in held)


def test_normalised_texts_are_those_of_python(spark):
    import sys
    import unicodedata

    known = [c for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs")]
    rng = random.Random(5)
    texts = [f"{c} x{c}́{rng.choice(known)}" for c in known] + ["", " 　 ", "​﻿"]
    gone = dict.fromkeys(map(ord, "​‌‍⁠﻿"))
    rows = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", cluster.T.dedup_text(F.col("t")).alias("n")).toPandas()
    assert len(rows) == len(texts)
    assert [t for t, n in zip(rows.t, rows.n, strict=True) if n != " ".join(unicodedata.normalize("NFKC", t).translate(gone).casefold().split())] == []


def test_texts_without_a_vector_are_not_shuffled(spark, tmp_path):
    from quarrylake.plans import q_retrieval

    pd.DataFrame({"doc_id": range(50), "text": "some text", "lang": "en"}).to_parquet(f"{tmp_path}/documents.parquet", index=False)
    pd.DataFrame({"vec_id": [3, 4, 4, 90], "embedding": [[1.0, 0.5]] * 4, "label": 1}).to_parquet(f"{tmp_path}/embeddings.parquet", index=False)
    pd.DataFrame({"item_id": [3], "text": ["some"]}).to_parquet(f"{tmp_path}/benchmark.parquet", index=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = q_retrieval._texts(spark, str(tmp_path))[0].select("chunk_id", "text")
        assert sorted(r.chunk_id for r in texts.collect()) == [3, 4, 4]
        steps = plan(texts).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < steps.index("Exchange hashpartitioning") < steps.index("LeftSemi") < steps.index("FileScan")
