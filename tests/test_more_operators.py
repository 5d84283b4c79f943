"""Operators without SQL: against plain Python, examples and round trips."""

import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.functions import rules as R
from quarrylake.operators import agent, chunking, dedup, quality, records, retrieval, seams
from quarrylake.sources import html, remote, sheets, store

MARKDOWN = """intro text that is long enough to stay here on its own

# Car

## Battery

1. Size of the pack

It has 80 kWh and more words to say so.

2. Charging time

Half an hour, as they say, or a little more than that.

## Warranty

**Terms**

Ten years for all of it, and no end to that.

SERVICE POINTS

Everywhere, 24 hours.

# Other

short
"""


def test_section_parts():
    parts = chunking.section_parts_of(MARKDOWN, 60, 5)
    assert [p[0] for p in parts][0] == "" and {"Battery", "Warranty", "Other"} <= {p[0] for p in parts}
    assert all(len(t) <= 60 for _, _, t in parts)
    long = chunking.section_parts_of("# A\n\n" + "x" * 150, 60, 10)
    assert [len(t) for _, _, t in long] == [60, 60, 50]
    with pytest.raises(ValueError):
        chunking.section_parts_of("x", 5, 5)


def test_hierarchical_chunks():
    out = chunking.hierarchical_of(MARKDOWN, 2000)
    assert all(t and MARKDOWN[a:b].strip() for *_, a, b, t in out)
    paths = [p for p, *_ in out]
    assert ["Car", "Battery"] in paths and all(p != ["Other"] for p in paths)  # short, without a digit: gone
    small = chunking.hierarchical_of(MARKDOWN, 45, 10, root="Root")
    assert all(p[0] == "Root" for p, *_ in small) and any(n > 1 for _, _, _, n, *_ in small)
    assert {"1 Size of the pack", "2 Charging time", "Terms", "SERVICE POINTS"} <= {x for p, *_ in small for x in p}
    again = [t for p, _, k, n, _, _, t in small if n > 1 and k > 1]
    assert again and all(len(t) <= 45 + 11 for t in again)


def test_boundary_chunks():
    text = "One sentence here. " * 200
    out = chunking.boundary_of(text)
    assert all(len(x) <= 1500 for x in out) and all(x.endswith(".") for x in out[:-1])
    assert chunking.boundary_of("  \n ") == [] and chunking.boundary_of("x" * 4000)[0] == "x" * 1500


def test_chunkers_by_name(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    for name in chunking.CHUNKERS:
        assert {r.doc_id for r in chunking.chunked(docs, name).collect()} == {1}, name
    with pytest.raises(ValueError):
        chunking.chunked(docs, "no such")


def test_tables_lists_and_loose_ends_of_pages():
    page = '<body><nav><a href="/">no</a><article><h1>T</h1><p>Some <b>bold</b> and <a href="/x">a link</a></p><ol><li>one<li>two</ol><table><tr><th>a<th>b<tr><td>1|2<td>2</table><img src="p.png"><a href="f.PDF?x">doc</a><aside>gone'
    *_, text, markdown, meta, assets = html.parse(page)
    assert "no" not in text.split() and "gone" not in text and meta == {}
    assert "Some **bold** and [a link](/x)" in markdown and "1. one\n\n2. two" in markdown
    assert "| a | b |\n| --- | --- |\n| 1/2 | 2 |" in markdown
    assert assets == [{"kind": "img", "source": "p.png"}, {"kind": "pdf", "source": "f.PDF?x"}]


def test_embedding_cells_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base + rng.normal(scale=0.08, size=base.shape)
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    vectors = spark.createDataFrame(rows, "chunk_id long, pos long, embedding array<float>").repartition(3)
    exact = {(r.canonical_id, r.duplicate_id) for r in dedup.embedding_matches(vectors).collect()}
    cells = {(r.canonical_id, r.duplicate_id) for r in dedup.embedding_cell_matches(vectors, per_cell=20).collect()}
    assert len(exact) > 200 and cells <= exact and len(cells) / len(exact) >= 0.9


def test_incremental_order(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "x"])
    old = spark.createDataFrame([(1, 1, " ".join(words)), (2, 2, "ﬁne ＡＢＣ straße")], "chunk_id long, pos long, text string")
    new = spark.createDataFrame([(10, 1, "FINE abc STRASSE"), (11, 2, near), (12, 3, near), (13, 4, "other words entirely")], "chunk_id long, pos long, text string")
    got = {r.duplicate_id: (r.canonical_id, r.layer) for r in dedup.incremental(old, new, 12).collect()}
    assert got == {10: (2, "exact_sha256"), 11: (1, "simhash"), 12: (11, "exact_sha256")}


def test_normalised_keys_beyond_ascii(spark):
    texts = ["Café", "Café", "ＣＡＦÉ", "STRASSE", "straße", "a​b", "AB", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumn("pos", F.col("chunk_id"))
    got = {(r.canonical_id, r.duplicate_id) for r in dedup.exact_matches(rows).collect()}
    assert got == {(0, 1), (0, 2), (3, 4), (5, 6)}


def test_workbooks_round_trip(spark):
    book = sheets.workbook([["a", 1.5, None, "x < & y"], [True, "two\nlines", "\x01bad"]])
    assert list(sheets.rows_of(book)) == [(1, 1, {1: "a", 2: "1.5", 4: "x < & y"}), (1, 2, {1: "True", 2: "two\nlines", 3: "bad"})]
    held = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="3"><c r="A3" t="s"><v>0</v></c><c r="AB3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"/></row></sheetData></worksheet>')
    assert list(sheets.rows_of(held.getvalue())) == [(1, 3, {1: "shared", 28: "rich", 3: "true"})]


def test_tsv_cells(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('a\tb\n"one\ntwo"\t"say ""so"""\n', encoding="utf-8")
    assert [tuple(r) for r in sheets.read_tsv(spark, f"file://{tmp_path}/x.tsv", "a string, b string").collect()] == [("one\ntwo", 'say "so"')]


class _Remote(BaseHTTPRequestHandler):
    def do_GET(self):
        page = int(self.path.split("page=")[1].split("&")[0])
        items = [{"id": str(i), "content": f"text {i}"} for i in range(7)][(page - 1) * 3 : page * 3]
        body = json.dumps({"total": 7, "chunks": [*items, "not an object"]}).encode()
        self.send_response(200)
        self.send_header("Content-Type", "text/html; charset=latin-1")
        self.end_headers()
        self.wfile.write(body + "é".encode("latin-1") * self.path.startswith("/latin"))

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), _Remote)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_chunks_and_pages(spark, endpoint):
    raw = remote.remote_chunks(spark, f"{endpoint}/chunks", page_size="3", dataset="d")
    got = records.payload_hits(raw).select("chunk_id", "text").collect()
    assert sorted((r.chunk_id, r.text) for r in got) == [(str(i), f"text {i}") for i in range(7)]
    urls = spark.createDataFrame([(f"{endpoint}/latin?page=9&",), ("ftp://x/y",)], "url string")
    pages = {r.url: r for r in remote.fetched(urls).collect()}
    assert pages[f"{endpoint}/latin?page=9&"].html.endswith("é") and "only http" in pages["ftp://x/y"].error


def test_parsers_are_seams(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"one")), ("b.pdf", bytearray(b"\xff"))], "path string, content binary")
    got = {r.path: r for r in remote.documents_to_markdown(files, {"plain": lambda b: "# " + b.decode()}, "plain").collect()}
    assert got["a.pdf"].markdown == "# one" and "UnicodeDecodeError" in got["b.pdf"].error
    with pytest.raises(ValueError):
        remote.documents_to_markdown(files, {}, "plain")
    elements = remote.document_elements(files, lambda b: [("picture", [1, 2], "c"), ("table", [3], "")]).collect()
    assert sorted((e.path, e.element_id) for e in elements) == [("a.pdf", "picture-001"), ("a.pdf", "table-002"), ("b.pdf", "picture-001"), ("b.pdf", "table-002")]


def test_raw_files_and_manifests(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "x").mkdir()
    (tmp_path / "x/manifest.json").write_text('{"document_id": "1", "updated_at": "2024-01-01T00:00:00"}')
    (tmp_path / "y").mkdir()
    (tmp_path / "y/manifest.json").write_text("{broken")
    (tmp_path / "z").mkdir()
    (tmp_path / "z/manifest.json").write_text('{"document_id": "2", "updated_at": "2025-01-01T00:00:00"}')
    assert [r.document_id for r in store.manifests(spark, root).collect()] == ["2", "1"]
    assert store.manifests(spark, f"{root}/none").count() == 0 and store.list_keys(spark, root).count() == 3
    (tmp_path / "d.md").write_text("# é", encoding="utf-8")
    raw = store.read_raw(spark, f"{root}/d.md").first()
    assert (raw.name, raw.content_type, bytes(raw.content).decode()) == ("d.md", "text/markdown", "# é")
    assert store.read_markdown(spark, f"{root}/d.md") == "# é" and store.read_markdown(spark, f"{root}/none.md") == ""
    with pytest.raises(FileNotFoundError):
        store.read_raw(spark, f"{root}/none.pdf")


def test_store_errors(spark, tmp_path):
    held = store.DocumentStore(spark, f"file://{tmp_path}/s")
    docs = spark.createDataFrame([("a", "d", "n", "text", None)], "document_id string, dataset_id string, name string, source_type string, created_at timestamp")
    chunks = spark.createDataFrame([("c1", "t", 1, "a", 0, {"k": "v"})], "chunk_id string, text string, pos long, document_id string, chunk_index int, metadata map<string,string>")
    held.write_documents(docs, chunks)
    for bad in (lambda: held.replace_chunks("b", chunks), lambda: held.delete_documents(["b"]), lambda: held.table("none")):
        with pytest.raises(KeyError):
            bad()
    held.delete_documents(["b"], strict=False)
    assert held.chunks([]).count() == 0 and held.chunks(["a"]).count() == 1
    held.annotate(chunks.withColumn("text", F.lit("new")))
    assert held.chunks().first().text == "new"
    held.delete_all()
    assert held.chunks().count() == 0 and held.documents_with_counts().count() == 0
    assert store.column_or(docs, "deleted_at", F.lit(1)) is not None


def test_model_seams(spark):
    class Client:
        provider, model = "p", "m"

        def __init__(self, fails=False):
            self.fails = fails

        def embed(self, texts):
            if self.fails:
                raise RuntimeError("down")
            return [[float(len(t)), 1.0] for t in texts]

        def complete(self, prompt):
            if "fail" in prompt:
                raise RuntimeError("no")
            return '```json\n{"verdict": "' + prompt[:2] + '", "n": 3}\n```' if "names" not in prompt else '["A", "B", "A", "zz"]'

    rows = spark.createDataFrame([(1, "ab"), (2, "fail"), (3, "")], "query_id long, text string")
    got = {r.query_id: r for r in seams.embedded(rows, "query_id", Client(), 2).collect()}
    assert got[1].embedding == [2.0, 1.0] and got[1].model == "m"
    client, tried = seams.first_available([Client(True), Client()])
    assert client is not None and [t["error"] is None for t in tried] == [False, True] and seams.first_available([Client(True)])[0] is None
    said = seams.completed(rows, "query_id", lambda t: t, Client())
    assert {r.query_id: r.error is None for r in said.collect()} == {1: True, 2: False, 3: True}
    graded = {r.query_id: (r.verdict, r.n) for r in seams.graded(said, "query_id", {"verdict": "unknown", "n": 0}).collect()}
    assert graded == {1: ("ab", "3"), 2: ("unknown", "0"), 3: ("", "3")}
    named = spark.createDataFrame([(1, "names"), (2, "fail")], "query_id long, text string")
    assert {r.query_id: r.entities for r in seams.detected(named, Client(), ["A", "B"]).collect()} == {1: ["A", "B"], 2: []}
    groups = spark.createDataFrame([(["x", "y"],)], "variants array<string>")
    mapper = type("M", (), {"complete": lambda self, p: '[{"variant": "x", "canonical": "X", "type": "t"}]'})()
    assert sorted(tuple(r) for r in seams.mapped_names(groups, mapper).collect()) == [("x", "X", "t"), ("y", "y", "other")]
    answers = spark.createDataFrame([(1, "q", "r", "g")], "question_id long, question string, response string, ground_truth string")
    scored = seams.scored(answers, {"good": lambda q, r, g: 0.5, "bad": lambda q, r, g: 1 / 0}).first()
    assert (scored.good, scored.bad) == (0.5, None)
    assert json.loads(seams.EchoModel().complete("a b c"))[1] == {"subject": "b", "predicate": "before", "object": "c"}
    chunks = spark.createDataFrame([("d", "s", i, f"c{i}", "t" * 400) for i in range(12)], "document_id string, section string, chunk_index int, chunk_id string, text string")
    context = seams.generation_contexts(chunks).first()
    assert len(context.text) == 3000 and context.source_chunk_ids == ["c0", "c1", "c2", "c3", "c4"]


def test_rerankers(spark):
    rows = [(q, c, float(c), c + 1, "x", f"q{q}", f"t{c}") for q in (1, 2) for c in range(4)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int, retriever string, question string, text string")

    def scorer(pairs):
        if any(q == "q2" for q, _ in pairs):
            raise RuntimeError("model is gone")
        return [-float(t[1:]) for _, t in pairs]

    got = retrieval.reranked(hits.repartition(2, "query_id"), 2, scorer).collect()
    by = {q: [(r.chunk_id, r.reranker) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2)}
    assert by[2] == [(3, "score"), (2, "score")]
    assert [c for c, _ in by[1]] in ([0, 1], [3, 2])  # both queries may share a batch, which then falls back
    bad = spark.createDataFrame([(1, [0, 0])], "query_id long, indices array<int>")
    with pytest.raises(Exception, match="places"):
        retrieval.reordered_by_provider(hits, bad, 3).collect()
    subs = retrieval.sub_queries(spark.createDataFrame([(1, "a b"), (2, "boom")], "query_id long, text string"), lambda t: t.split() if t != "boom" else 1 / 0)
    assert sorted((r.query_id, r.sub, r.text) for r in subs.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "boom")]
    with pytest.raises(ValueError):
        retrieval.fuse(hits, 3, "no such")


def test_quality_methods():
    assert quality.methods([" exact_duplicates", "NEAR_duplicates", "exact_duplicates"]) == ["exact_duplicates", "near_duplicates"]
    for names in (["no such"], ["semantic_verifier"]):
        with pytest.raises(quality.MethodError):
            quality.methods(names)
    assert quality.methods(["semantic_verifier"], client=object()) == ["semantic_verifier"]


def test_answer_flow_routes(spark):
    config = agent.Config().with_(top_k=3, fusion=None)
    assert config.top_k == 3 and config.fusion == "rrf"
    snap = json.loads(spark.range(1).select(config.snapshot().alias("c")).first().c)
    assert snap["top_k"] == 3 and snap["min_fused"] is None
    rows = spark.createDataFrame([(0, True, 0.1), (0, False, 0.9), (0, False, None), (3, True, 0.1)], "step int, missing boolean, best double")
    assert [r.w for r in rows.select(agent.after_rerank(F.col("step"), F.col("missing"), F.col("best"), 0.5).alias("w")).collect()] == ["transform", "generate", "transform", "generate"]
    hits = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (2, 20, 0.9, 1)], "query_id long, chunk_id long, score double, rank int")
    state = spark.createDataFrame([(1, [10]), (2, [20])], "query_id long, rejected array<long>")
    assert sorted((r.query_id, r.chunk_id) for r in agent.without_rejected(hits, state).collect()) == [(1, 11), (2, 20)]
    tried = spark.createDataFrame([(1, "a", "open", ["a"]), (2, "b", "open", ["b"])], "query_id long, text string, status string, tried array<string>")
    again = spark.createDataFrame([(1, ["a", "c"]), (2, ["b"])], "query_id long, texts array<string>")
    got = {r.query_id: (r.text, r.status, r.tried) for r in agent.transformed(tried, again).collect()}
    assert got == {1: ("c", "open", ["a", "c"]), 2: ("b", "exhausted", ["b"])}
    given = spark.createDataFrame([(1, 5, "x")], "query_id long, chunk_id long, text string")
    found = spark.createDataFrame([(1, 6, "y"), (2, 7, "z")], "query_id long, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id long, text string")
    assert sorted((r.query_id, r.chunk_id, r.origin) for r in agent.resolved_evidence(asked, given, found).collect()) == [(1, 5, "explicit"), (2, 7, "retrieved"), (3, None, "none")]


def test_answers_are_checked(spark):
    asked = spark.createDataFrame([(i, "a question") for i in range(1, 6)] + [(6, " ")], "query_id long, text string")
    evidence = spark.createDataFrame([(i, c, c - 10 * i, f"evidence text {c} of it") for i in range(1, 7) for c in (10 * i + 1, 10 * i + 2)], "query_id long, chunk_id long, rank int, text string")
    said = spark.createDataFrame([(1, "So it is [2]."), (2, "Out of range [7]."), (3, '{"answer": "Just so.", "used_citation_ids": [2]}'), (4, "Not found in the documents.")], "query_id long, answer string")
    got = {r.query_id: (r.answer, r.status, r.citations) for r in agent.generated(asked, evidence, said).collect()}
    assert got[1] == ("So it is [1].", "answered", [12]) and got[3] == ("Just so.", "answered", [32])
    assert [got[i][1] for i in (2, 4, 6)] == ["not_found"] * 3
    assert got[5][1] == "answered" and got[5][0].startswith("evidence text 51")


def test_ingest_tables(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>" + "some words " * 30), (2, "<p>" + "seen before " * 20)], "page_id long, html string")
    old = spark.createDataFrame([(5, 5, "seen before " * 20)], "chunk_id long, pos long, text string")
    parse = lambda p: html.parsed(p).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    out = agent.ingested(pages, old, chunking.windows, parse)
    flags = {r.doc_id: r.deduplication for r in out["chunks"].collect()}
    assert flags[1] is None and flags[2].canonical_id == 5 and out["groups"].count() == 0


def test_rule_corners(spark):
    rows = spark.createDataFrame([("VinX VF-8 plus and vf 9",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(R.entity_names(F.col("t"))).collect()] == [["VINX VF-8 PLUS", "AND VF 9"], ["GLOBAL".lower()]]
    lines = spark.createDataFrame([("only [1]\n[1] ref",), ("Sources:",)], "t string")
    assert [r[0] for r in lines.select(R.without_reference_list(F.col("t"))).collect()] == ["only [1]", ""]
