"""Operators on small frames, against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import chunking, dedup, evaluation, graph, quality, retrieval
from quarrylake.sources import html, tables


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, retriever string")


def test_fusion_of_overlapping_channels(spark):
    found = hits(spark, [("q", "a", 3.0, 1, "bm25"), ("q", "b", 2.0, 2, "bm25"), ("q", "b", 0.9, 1, "dense"), ("q", "c", 0.8, 2, "dense"), ("q", "b", 0.1, 9, "dense")])
    out = [(r.chunk_id, r.score, r.retriever, r.rank) for r in retrieval.rrf(found, 2).orderBy("rank").collect()]
    assert out == [("b", round(1 / 62 + 1 / 61, 9), "bm25+dense", 1), ("a", round(1 / 61, 9), "bm25", 2)]
    weighted = {r.chunk_id: r.score for r in retrieval.rrf(found, 9, weights={"bm25": 0.55, "dense": 0.45}).collect()}
    assert weighted["b"] == round(0.55 / 62 + 0.45 / 61, 9)
    with pytest.raises(Exception, match="ranks begin at 1"):
        retrieval.rrf(hits(spark, [("q", "a", 1.0, 0, "bm25")]), 5).collect()
    with pytest.raises(ValueError, match="negative"):
        retrieval.rrf(found, 5, rrf_k=-1)
    assert retrieval.rrf(found.limit(0), 5).count() == 0


def test_scaling_thresholds_and_boost(spark):
    found = hits(spark, [("q", "a", 3.0, 1, "bm25"), ("q", "b", 2.0, 2, "bm25"), ("q", "c", 1.0, 3, "bm25"), ("r", "a", 5.0, 1, "bm25")])
    got = {(r.query_id, r.chunk_id): (r.norm, r.removed) for r in retrieval.thresholded(found, min_score=1.5, min_norm=0.6).collect()}
    assert got == {("q", "a"): (1.0, None), ("q", "b"): (0.5, "min_norm_score"), ("q", "c"): (0.0, "min_score"), ("r", "a"): (1.0, None)}
    boosted = {(r.query_id, r.chunk_id): r.score for r in retrieval.boosted(found, F.lit(9.0)).collect()}
    assert boosted == {("q", "a"): 1.4, ("q", "b"): 0.7, ("q", "c"): 0.0, ("r", "a"): 7.0}
    same = retrieval.boosted(hits(spark, [("q", "a", 2.0, 1, "x"), ("q", "b", 2.0, 2, "x")]), F.lit(1.0)).collect()
    assert [r.score for r in same] == [0.0, 0.0]
    assert retrieval.evidence_floor(found, 2).count() == 3


def test_simhash_bits_and_bands(spark):
    def plain(words, n=4):
        if not words:
            return 0
        grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
        votes = [0] * 64
        for g in grams:
            h = int(hashlib.sha256(g.encode()).hexdigest(), 16)
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        return sum(1 << b for b in range(64) if votes[b] >= 0)

    texts = ["", "a", "a b c d", "a b c d e f g h " * 6, "a b c d e f g h " * 6 + "x", "z y x w v u", "A  B c d", None]
    for t in texts:
        assert T.simhash64((t or "").split()) % (1 << 64) == plain((t or "").split())
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, pos long, text string")
    prints = {i: plain((t or "").lower().split()) for i, t in enumerate(texts)}
    for distance in (0, 6, 20):
        got = {(r.canonical_id, r.duplicate_id) for r in dedup.simhash_matches(df, distance).collect()}
        reps = {}
        for i, p in prints.items():
            reps.setdefault(p, i)
        want = {(reps[p], i) for i, p in prints.items() if reps[p] != i} | {(a, b) for p, a in reps.items() for q, b in reps.items() if a < b and (p ^ q).bit_count() <= distance}
        assert got == want


def test_cascade_leaves_out_flagged_chunks(spark):
    df = spark.createDataFrame([(1, 1, "one two three"), (2, 2, "ONE  two three"), (3, 3, "one two​ three"), (4, 4, "other words here")], "chunk_id long, pos long, text string")
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (4, 4, [1.0, 0.01]), (5, 5, [0.0, 0.0]), (6, 6, None)], "chunk_id long, pos long, embedding array<double>")
    got = {(r.canonical_id, r.duplicate_id, r.layer) for r in dedup.cascade(df, v, distance=0).collect()}
    assert got == {(1, 2, "exact_sha256"), (1, 3, "exact_sha256"), (1, 4, "embedding")}


def test_text_functions(spark):
    df = spark.createDataFrame([("  Đường  ÉTÉ\n_x1 ", "1.234,5", "see [2] and [1], [2]")], "t string, n string, c string")
    row = df.select(T.fold(F.col("t")).alias("fold"), T.tokens(F.col("t")).alias("tokens"), T.number(F.col("n")).alias("number"), T.citation_markers(F.col("c")).alias("marks"), T.slug(F.col("t")).alias("slug"), T.dedup_text(F.lit("ﬁ​X")).alias("nfkc")).first()
    assert (row.fold, row.tokens, row.number, row.marks, row.slug, row.nfkc) == ("duong ete _x1", ["duong", "ete", "_x1"], 1234.5, [2, 1], "duong-ete-x1", "fix")
    numbers = spark.createDataFrame([("160,000",), ("160.000",), ("1.5",), ("x",)], "n string").select(T.number(F.col("n")).alias("v")).collect()
    assert [r.v for r in numbers] == [160.0, 160000.0, 1.5, None]
    grams = spark.range(1).select(T.shingles(F.array(*map(F.lit, "a b c".split())), 2).alias("two"), T.shingles(F.array(F.lit("a")), 2).alias("one"), T.shingles(F.array().cast("array<string>"), 2).alias("none")).first()
    assert (grams.two, grams.one, grams.none) == (["a b", "b c"], ["a"], [])


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "x"]), (2, ["a"], []), (3, ["a", "b"], ["b", "b"]), (4, [], ["z"])], "question_id long, retrieved array<string>, relevant array<string>")
    got = {r.question_id: (r.recall, r.rr, r.truth_rank, r.coverage) for r in evaluation.metrics(df, 5).collect()}
    assert got == {1: (0.5, round(1 / 3, 6), 3, 0.0), 2: (0.0, 0.0, None, 0.0), 3: (0.5, 0.5, 2, 1.0), 4: (0.0, 0.0, None, 0.0)}


def test_sequence_numbers_without_one_task(spark):
    df = spark.range(1000).repartition(7)
    got = [r.seq for r in evaluation.sequence(df, F.desc("id")).orderBy(F.desc("id")).collect()]
    assert got == list(range(1, 1001))


def test_fences_by_index(spark):
    values = [1, 2, 2, 3, 5, 8, 13, 100]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1)] * 9 + [("c", 4)], "k string, v int")
    got = {r.k: (r.q1, r.q3, r.fence) for r in graph.upper_fence(df, "v", ["k"]).collect()}
    assert got == {"a": (2, 13, 13 + 2.5 * 11), "b": (1, 1, None), "c": (4, 4, None)}


def test_gates_and_deletes(spark):
    t = spark.createDataFrame([(1, "d", 1, "it", "is", "x", "it is"), (1, "d", 1, "thing", "is", "stuff", "z"), (1, "d", 1, "a b c d e", "is", "x", "z"), (1, "d", 1, "a", "is a very long one", "x", "z"), (1, "d", 1, "a", "is", "b", "nowhere"), (1, "e", 1, "a", "is", "b", "A  is b")], "triple_id long, doc_id string, chunk_id long, subject string, predicate string, object string, evidence string")
    texts = spark.createDataFrame([(1, "so a IS b.")], "chunk_id long, text string")
    got = [r.reason for r in graph.gated(t, texts, ["thing", "stuff"], 4, 4).collect()]
    assert sorted(got) == sorted(["pronoun_endpoint", "both_generic", "clause_endpoint", "clause_predicate", "evidence_not_found", "ok"])
    assert graph.without_document(t, "e").count() == 4  # the other document's same edge goes too


def test_facts_and_conflicts(spark):
    df = spark.createDataFrame([(1, "Model X has 5 years cover. Costs 1,2 billion."), (2, "model x: 60 months; 450 km"), (3, "model x runs 500 km"), (4, None)], "chunk_id long, text string")
    found = quality.facts(df, r"model [a-z]")
    assert {(r.chunk_id, r.attribute, r.norm, r.unit) for r in found.collect()} == {(1, "duration", 60.0, "month"), (1, "price", 1.2e9, "money"), (2, "duration", 60.0, "month"), (2, "distance", 450.0, "km"), (3, "distance", 500.0, "km")}
    assert [(r.low_value, r.high_value) for r in quality.numeric_conflicts(found).collect()] == [(450.0, 500.0)]


def test_sections_windows_and_packing():
    text = "intro\n# A\nbody a\n## B\n\n### C\nbody c\n# D\nlast"
    got = chunking.sections_of(text)
    assert [(t, level, path, body) for t, level, path, body, _, _ in got] == [("", 0, [], "intro"), ("A", 1, ["A"], "body a"), ("C", 3, ["A", "B", "C"], "body c"), ("D", 1, ["D"], "last")]
    assert all(text[a:b] == body for _, _, _, body, a, b in got)
    words = "word " * 1000
    spans = chunking.windows_of(words, 100, 20)
    assert all(b - a <= 100 for a, b in spans) and all(x[1] >= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] >= len(words) - 1
    assert chunking.windows_of("x" * 250, 100) == [(0, 100), (100, 200), (200, 250)]
    assert chunking.packed_of("a\n\nb\n\n" + "c" * 30, 10) == ["a\n\nb", "c" * 10, "c" * 10, "c" * 10]


def test_html_pages():
    title, lang, canonical, n, heads, links, images, text, markdown, *_ = html.parse('<html lang="fr"><head><title> T &amp; x</title><link rel="canonical" href="u"></head><nav>no<a href=1>x</a></nav><h1>H</h1><p>one<p>One<br>two <a href=2>k</a><img><script>p("</p>")</script>')
    assert (title, lang, canonical, n, heads, links, images) == ("T & x", "fr", "u", 1, ["H"], 1, 1)
    assert text == "H\none\nOne\ntwo k" and markdown == "# H\n\none\n\ntwo [k](2)"


def test_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "t", 0, "d1", 0, {"k": "v"}), ("c2", "u", 1, "d2", 0, None)], tables.CHUNK)
    path = f"file://{tmp_path}/chunks"
    assert tables.read_chunks(spark, path).count() == 0
    tables.write_chunks(chunks, path)
    tables.write_chunks(chunks.where("document_id = 'd2'").withColumn("text", F.lit("new")), path)
    assert {(r.chunk_id, r.text) for r in tables.read_chunks(spark, path).collect()} == {("c1", "t"), ("c2", "new")}
    assert tables.read_chunks(spark, path, ["d1"]).first().metadata == {"k": "v"}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    first = tables.upsert(spark, f"file://{tmp_path}/t", rows, ["k"])
    second = tables.upsert(spark, first, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(second).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    left, skipped = tables.guarded_delete(rows, rows, rows.where("k = 1"), "k")
    assert [r.k for r in left.collect()] == [1] and [r.k for r in skipped.collect()] == [1]
