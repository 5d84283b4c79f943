"""Evaluation-warehouse, graph, page, conversation and stream queries.

Orders stand in for runs, line items for results, customers for datasets; users, event types and values for
triples' ends and predicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import agent, dedup, evaluation, graph, retrieval
from quarrylake.operators.cluster import shared_folder
from quarrylake.sources import html
from quarrylake.sources.tables import appended, table
from quarrylake.streaming import events as stream


def run_metrics(spark, d):
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("recall"), F.col("l_discount").alias("mrr"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("passed"))
    return evaluation.averages(results, ["run_id"], ["recall", "mrr"], "passed")


def run_progress(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(7).alias("total"))
    results = table(spark, d, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") == "R").alias("failed"))
    return evaluation.progress(runs, results, "run_id")


def run_comparison(spark, d):
    """Per customer segment and status: averages and whether any order is large (LEFT JOIN, BOOL_OR)."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = c.join(o, c.c_custkey == o.o_custkey, "left")
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("o_orderkey").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


def inherited_runs(spark, d):
    """Suppliers whose parts cover at least half of the brands of the first five suppliers' parts."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    known = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_suppkey").alias("run_id"), F.col("p_brand").alias("question")).distinct()
    own = known.where("run_id < 5").select("question").distinct()
    return evaluation.inherited(known, "run_id", own, "question").withColumn("total", F.col("total").cast("long"))


def pending_questions(spark, d):
    """Orders without a returned line (anti join), numbered by price."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'")
    pending = o.join(l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return evaluation.sequence(pending.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"))


def approved_questions(spark, d):
    """Left joins and an aggregated EXISTS: customers with counts of orders and of large ones."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    return c.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("large", F.lit(0)).alias("large"), (F.coalesce("large", F.lit(0)) > 0).alias("has_large"))


def affected_questions(spark, d):
    """Semi-join on array membership: users whose events have a key among the most frequent five."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    lists = e.groupBy("user_id").agg(F.collect_set("k").alias("keys"))
    top = e.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(5)
    return lists.select("user_id", F.explode("keys").alias("k"), F.size("keys").cast("long").alias("n_keys")).join(top.select("k"), "k", "left_semi").select("user_id", "n_keys").distinct()


def document_listing(spark, d):
    """Documents with chunk counts and latest change: LEFT JOIN, GROUP BY, order by max(coalesce)."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = o.join(l, o.o_orderkey == l.l_orderkey, "left").groupBy("o_orderkey", "o_orderdate").agg(F.count("l_linenumber").alias("chunks"), F.max(F.coalesce("l_shipdate", "o_orderdate")).alias("changed"))
    return joined.orderBy(F.desc("changed"), "o_orderkey")


def canonical_coverage(spark, d):
    """Brands with more than ten parts of some size, most first."""
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_brand").alias("canonical"), "p_size").agg(F.count("*").alias("coverage")).where("coverage > 2")


def reconcile_ids(spark, d):
    return evaluation.reconcile(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


def stratified_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return evaluation.stratified(rows, "lang", "doc_id", 12, 60)


def upsert_latest(spark, d):
    """Last write wins: each user's latest event (ties: the larger id)."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return dedup.latest(e, ["user_id"], "at").select("user_id", "event_id", "event_type")


def idempotent_append(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "k")
    return appended(o.where("k % 2 = 0"), o.where("k % 3 = 0"), ["k", "o_orderstatus"]).select("k", "o_orderstatus")


def last_assistant_turn(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.sha2(F.max_by("text", "turn"), 256).alias("text_sha256"))


def conversation_shape(spark, d):
    c = table(spark, d, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("before", F.lag("role").over(own)).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.max(F.length("text")).cast("long").alias("longest"))


def _triples(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("triple_id"), (F.col("event_id") % 50).alias("doc_id"), (F.col("event_id") % 400).alias("chunk_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("key "), F.col("k")).alias("object"))


_TRIPLES = "t AS (SELECT event_id AS triple_id, event_id % 50 AS doc_id, event_id % 400 AS chunk_id, 'user ' || user_id AS subject, event_type AS predicate, 'key ' || json_extract_string(props, '$.k') AS object FROM events)"


def kg_mentions(spark, d):
    return graph.mentions(_triples(spark, d)).select("key", "freq", "name", F.col("words").cast("long").alias("words"))


def kg_predicates(spark, d):
    return graph.canonical_predicates(_triples(spark, d))


def kg_edges(spark, d):
    return graph.edges(_triples(spark, d))


def kg_fence(spark, d):
    e = table(spark, d, "events").select("event_type", F.round("value", 2).alias("value"))
    return graph.upper_fence(e, "value", ["event_type"]).select("event_type", "n", "q1", "q3", F.round("fence", 6).alias("fence"))


def kg_reach(spark, d):
    """Nodes within two hops of three users, over edges of weight two and more."""
    strong = graph.edges(_triples(spark, d)).where("weight >= 2")
    seeds = spark.createDataFrame([("user 1",), ("user 2",), ("user 3",)], "seed string")
    return graph.reach(strong, seeds, 2).select("seed", "node", F.col("hop").cast("long").alias("hop"))


def kg_chunk_scores(spark, d):
    triples = _triples(spark, d)
    seeds = spark.createDataFrame([("user 1",), ("user 2",)], "seed string")
    return graph.chunk_scores(graph.reach(triples, seeds, 1), triples).select("seed", "chunk_id", "score")


def kg_delete_document(spark, d):
    return graph.without_document(_triples(spark, d), 7).groupBy("predicate").agg(F.count("*").alias("n"))


def html_parse(spark, d):
    p = html.parsed(table(spark, d, "pages"))
    return p.select("page_id", "title", "lang", "n_sections", "n_links", "n_images", F.sha2("text", 256).alias("text_sha256"), F.sha2("markdown", 256).alias("markdown_sha256"))


def page_domains(spark, d):
    p = table(spark, d, "pages").select(T.url_domain(F.col("url")).alias("domain"))
    return p.groupBy("domain").agg(F.count("*").alias("pages"))


def page_types(spark, d):
    """Ordered rules over URL and body: the first that holds names the type."""
    u, h = F.lower("url"), F.lower("html")
    kind = F.when(u.rlike(r"\.(pdf|jpg|png)$"), "file").when(h.contains("<table"), "table").when(u.contains("?page="), "listing").when(F.length("html") > 3000, "article").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"), F.max(F.length("html")).cast("long").alias("longest"))


def event_windows(spark, d):
    return stream.windowed(table(spark, d, "events"))


def event_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


def event_stream(spark, d):
    """The windows again, by a stream over the same files."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    return stream.run_to_table(stream.windowed(source), f"{root}/table", f"{root}/checkpoint")


def _staged_files(spark, d, rows, parts):
    """A table as files that a stream reads in so many turns: a file for each split of the input in all, so none grows with it."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    turn = -(-max(1, rows.rdd.getNumPartitions()) // parts)
    rows.repartition(parts * turn, F.col(rows.columns[0])).write.parquet(f"{root}/in")
    return root, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", turn).parquet(f"{root}/in")


def stream_upserts(spark, d):
    """Events as results that are written again and again: the latest of each user, over several micro-batches."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    root, source = _staged_files(spark, d, e, 4)
    stream.upsert_stream(source, f"{root}/out", ["user_id"], "event_id", f"{root}/checkpoint")
    return stream.upserted(spark, f"{root}/out", ["user_id"], "event_id").select("user_id", "event_id", "event_type")


def stream_worker(spark, d):
    """Conversations as tasks, one file at a time; run twice over the same input, no task is worked on twice."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    root, source = _staged_files(spark, d, c, 3)
    work = lambda rows: rows.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    for run in ("first", "again"):
        stream.worked_off(source, f"{root}/out", f"{root}/{run}", work, ["conv_id", "turn"])
    done = spark.read.parquet(f"{root}/out")
    return done.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("n"))


def stream_new_texts(spark, d):
    """Documents arriving by a stream: how many texts (normalised) are new."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.to_timestamp(F.lit("2024-01-01")).alias("ts")).where("text IS NOT NULL")
    root, source = _staged_files(spark, d, docs, 2)
    found = stream.run_to_table(stream.new_texts(source), f"{root}/out", f"{root}/checkpoint", "append")
    return found.agg(F.count("*").alias("n"), F.count_distinct("text_key").alias("keys"))


def answer_flow(spark, d):
    """The whole flow over benchmark items, small talk and unclear questions; retrieval is by term frequencies."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    talk = spark.createDataFrame([(100_001, "Hello!"), (100_002, "vf8"), (100_003, " "), (100_004, "zzzz qqqq xxxx yyyy wwww")], "query_id long, text string")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(talk)
    out = agent.answered(asked, lambda q: retrieval.sparse(docs, q, 5), docs, least=3.0)
    return out.select("query_id", "status", F.size(F.coalesce("citations", F.array().cast("array<long>"))).cast("long").alias("cited"), F.col("steps").cast("long").alias("steps"))


_FUNCTIONS = (run_metrics, run_progress, run_comparison, inherited_runs, pending_questions, approved_questions, affected_questions, document_listing, canonical_coverage, reconcile_ids, stratified_sample, upsert_latest, idempotent_append, last_assistant_turn, conversation_shape, kg_mentions, kg_predicates, kg_edges, kg_fence, kg_reach, kg_chunk_scores, kg_delete_document, html_parse, page_domains, page_types, event_windows, event_sessions, event_stream, stream_upserts, stream_worker, stream_new_texts, answer_flow)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_BOTH = "b AS (SELECT subject AS a, object AS b FROM e UNION SELECT object, subject FROM e)"
ORACLE = {
    "run_metrics": "SELECT l_orderkey AS run_id, count(*) AS n, round(avg(l_quantity), 6) AS avg_recall, round(avg(l_discount), 6) AS avg_mrr, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate FROM lineitem GROUP BY 1",
    "run_progress": "SELECT o_orderkey AS run_id, 7 AS total, count(l_orderkey) AS done, count(*) FILTER (l_returnflag = 'R') AS failed, 7 - count(l_orderkey) AS left FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'A') ON l_orderkey = o_orderkey GROUP BY 1",
    "run_comparison": "SELECT c_mktsegment, o_orderstatus, count(o_orderkey) AS orders, round(avg(o_totalprice), 4) AS avg_price, bool_or(o_totalprice > 400000) AS any_large FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "inherited_runs": "WITH k AS (SELECT DISTINCT l_suppkey AS run_id, p_brand AS q FROM lineitem JOIN part ON l_partkey = p_partkey), own AS (SELECT DISTINCT q FROM k WHERE run_id < 5) SELECT run_id, count(*) AS covered, (SELECT count(*) FROM own) AS total FROM k WHERE q IN (SELECT q FROM own) GROUP BY run_id HAVING count(*) * 2 >= (SELECT count(*) FROM own)",
    "pending_questions": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS seq FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "approved_questions": "SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_totalprice > 200000) > 0 AS has_large FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "affected_questions": "WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events), top AS (SELECT k FROM e GROUP BY k ORDER BY count(*) DESC, k LIMIT 5) SELECT user_id, count(DISTINCT k) AS n_keys FROM e GROUP BY user_id HAVING bool_or(k IN (SELECT k FROM top))",
    "document_listing": "SELECT o_orderkey, o_orderdate, count(l_linenumber) AS chunks, max(coalesce(l_shipdate, o_orderdate)) AS changed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY changed DESC, o_orderkey",
    "canonical_coverage": "SELECT p_brand AS canonical, p_size, count(*) AS coverage FROM part GROUP BY 1, 2 HAVING count(*) > 2",
    "reconcile_ids": "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, round(100.0::DOUBLE * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (a IS NOT NULL), 4) AS match_pct FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b",
    "stratified_sample": "SELECT doc_id, lang, n > 12 AS backfill FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY n > 12, doc_id LIMIT 60",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "idempotent_append": "SELECT DISTINCT o_custkey AS k, o_orderstatus FROM orders WHERE o_custkey % 3 = 0 AND (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey % 2 = 0)",
    "last_assistant_turn": "SELECT conv_id, max(turn) AS turn, sha256(max_by(text, turn)) AS text_sha256 FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "conversation_shape": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = before) AS repeats, max(length(text)) AS longest FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1",
    "kg_mentions": f"WITH {_TRIPLES} SELECT lower(s) AS key, count(*) AS freq, max(s) AS name, len(string_split(lower(s), ' '))::BIGINT AS words FROM (SELECT subject AS s FROM t UNION ALL SELECT object FROM t) GROUP BY 1",
    "kg_predicates": "SELECT event_type AS predicate, CASE WHEN count(*) < 3 THEN 'related_to' ELSE event_type END AS canonical FROM events GROUP BY event_type",
    "kg_edges": f"WITH {_TRIPLES} SELECT subject, predicate, object, count(*) AS weight, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1, 2, 3",
    "kg_fence": "SELECT event_type, n, q1, q3, CASE WHEN n >= 8 AND q3 > q1 THEN round(q3 + 2.5::DOUBLE * (q3 - q1), 6) END AS fence FROM (SELECT event_type, count(*) AS n, list_sort(list(round(value, 2)))[count(*) // 4 + 1] AS q1, list_sort(list(round(value, 2)))[3 * count(*) // 4 + 1] AS q3 FROM events GROUP BY 1)",
    "kg_reach": f"""WITH {_TRIPLES}, e AS (SELECT subject, object FROM t GROUP BY subject, predicate, object HAVING count(*) >= 2), {_BOTH}, s AS (SELECT unnest(['user 1', 'user 2', 'user 3']) AS seed),
        r AS (SELECT seed, seed AS node, 0::BIGINT AS hop FROM s UNION ALL SELECT seed, b, 1 FROM s JOIN b ON a = seed UNION ALL SELECT seed, y.b, 2 FROM s JOIN b x ON x.a = seed JOIN b y ON y.a = x.b)
        SELECT seed, node, min(hop) AS hop FROM r GROUP BY 1, 2""",
    "kg_chunk_scores": f"""WITH {_TRIPLES}, e AS (SELECT DISTINCT subject, object FROM t), {_BOTH}, s AS (SELECT unnest(['user 1', 'user 2']) AS seed),
        r AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM s UNION ALL SELECT seed, b, 1 FROM s JOIN b ON a = seed) GROUP BY 1, 2),
        o AS (SELECT seed, triple_id, chunk_id, min(hop) AS hop FROM t JOIN r ON node = subject OR node = object GROUP BY 1, 2, 3)
        SELECT seed, chunk_id, round(sum(0.1::DOUBLE / (hop + 1)), 6) AS score FROM o GROUP BY 1, 2""",
    "kg_delete_document": f"WITH {_TRIPLES} SELECT predicate, count(*) AS n FROM t WHERE (subject, predicate, object) NOT IN (SELECT subject, predicate, object FROM t WHERE doc_id = 7) GROUP BY 1",
    "page_domains": "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1",
    "page_types": r"SELECT CASE WHEN regexp_matches(lower(url), '\.(pdf|jpg|png)$') THEN 'file' WHEN contains(lower(html), '<table') THEN 'table' WHEN contains(lower(url), '?page=') THEN 'listing' WHEN length(html) > 3000 THEN 'article' ELSE 'other' END AS kind, count(*) AS pages, max(length(html)) AS longest FROM pages GROUP BY 1",
    "event_windows": _WINDOWS,
    "event_stream": _WINDOWS,
    "stream_upserts": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "stream_worker": "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS n FROM conversations GROUP BY 1",
    "stream_new_texts": r"SELECT count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS n, count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS keys FROM documents WHERE text IS NOT NULL",
    "event_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
}
