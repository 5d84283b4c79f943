"""Queries of the record-level and clustering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import chunking, cluster, records, retrieval
from quarrylake.plans import q_retrieval as R
from quarrylake.sources.tables import table


def _keys(spark, d):
    return table(spark, d, "part").select(F.explode(F.array(F.lower("p_name"), F.lower(F.substring_index("p_name", " ", 1)))).alias("key")).unionByName(table(spark, d, "customer").select(F.lower(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("key"))).distinct()


_KEYS = "k AS (SELECT lower(p_name) AS key FROM part UNION SELECT lower(string_split(p_name, ' ')[1]) FROM part UNION SELECT lower(c_mktsegment || ' ' || c_nationkey) FROM customer)"


def truthy_cells(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(records.truthy(F.translate("o_orderstatus", "FOP", "yx0"))).alias("yes"), F.count("*").alias("n"))


def id_cells(spark, d):
    c = F.concat_ws(", ", F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, "none"), F.col("o_custkey").cast("string"), F.lit(""), (F.col("o_orderkey") % 7).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(records.id_list(c), "|").alias("ids"))


def json_answers(spark, d):
    """Event properties as a model might wrap them."""
    p = F.col("props")
    wrapped = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("So: "), p, F.lit(" done"))).otherwise(F.substring(p, 1, 3))
    return table(spark, d, "events").select("event_id", F.get_json_object(records.json_object(wrapped), "$.k").cast("long").alias("k"))


def combined_filter(spark, d):
    l = table(spark, d, "lineitem")
    ok = records.allowed(F.col("l_suppkey"), list(range(0, 60)), F.nullif(F.col("l_returnflag"), F.lit("N")), ["R"], F.array("l_linestatus", F.lit("Z")), ["O"])
    return l.where(ok).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def any_column_like(spark, d):
    return table(spark, d, "part").where(records.any_like(["p_name", "p_brand", "p_type"], "Widg") | records.any_like(["p_brand"], "#1_")).select("p_partkey")


def keyword_page(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text")
    return records.keyword_page(docs, "Moron idíot", 2, 5).select("chunk_id", "total")


def hydrated_hits(spark, d):
    hits = retrieval.dense(R._vectors(spark, d), R._asking(spark, d), 10)
    texts = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "lang")
    return records.hydrated(hits, texts).select("query_id", "chunk_id", "rank", "lang")


def explained_hits(spark, d):
    channels = R._channels(spark, d)
    final = retrieval.rrf(channels, 5).select("query_id", "chunk_id", "rank")
    one, two = (channels.where(F.col("retriever") == n) for n in ("bm25", "dense"))
    return records.explained(final, first=one, second=two)


def best_score_first_place(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("query_id"), (F.col("event_id") % 37).alias("chunk_id"), F.col("value").alias("score"), F.col("event_id").alias("pos"))
    return records.best_score_first_place(e).select("query_id", "chunk_id", "score", "rank")


def last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", "value", F.col("event_id").alias("pos"))
    return records.last_wins(e, "key", "pos")


def assets_by_page(spark, d):
    l = table(spark, d, "lineitem")
    chunks = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.array((F.col("l_linenumber") % 3).cast("int"), F.lit(5)).alias("pages"))
    assets = l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), F.array((F.col("l_partkey") % 4).cast("int")).alias("pages"))
    return records.assets_by_page(chunks, assets).select("asset_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


def path_prefix(spark, d):
    p = table(spark, d, "part").groupBy("p_size").agg(F.collect_list(F.split("p_type", " ")).alias("paths"))
    return p.select("p_size", F.array_join(records.common_prefix(F.col("paths")), "/").alias("prefix"), F.size("paths").cast("long").alias("n"))


def evidence_context(spark, d):
    docs = table(spark, d, "conversations")
    hits = docs.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text")
    return records.context_of(hits).select("query_id", F.sha2("context", 256).alias("context_sha256"))


def fallback_answers(spark, d):
    docs = table(spark, d, "conversations")
    hits = docs.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text")
    return records.fallback_answer(hits).select("query_id", F.sha2("answer", 256).alias("answer_sha256"), "status")


def provider_payloads(spark, d):
    e = table(spark, d, "events")
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("content"), (F.col("event_id") % 9 + 1).alias("rank")))).otherwise(F.to_json(F.struct(F.lit("").alias("id"), F.col("event_id").cast("string").alias("chunk_id"), F.col("event_type").alias("text"), F.lit(0.5).alias("similarity"))))
    return records.payload_hits(e.select(payload.alias("payload"))).select("chunk_id", "text", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def entity_components(spark, d):
    """Nations linked through customers of the same balance band and segment, as components of keys."""
    c = table(spark, d, "customer")
    links = c.select(F.col("c_custkey").alias("a"), (F.floor(F.col("c_acctbal") / 5) + 10_000_000).cast("long").alias("b"))
    return cluster.components(links)


def entity_communities(spark, d):
    """Only counts: label propagation has no SQL."""
    c = table(spark, d, "customer")
    return cluster.communities(c.select(F.col("c_custkey").alias("a"), (F.floor(F.col("c_acctbal") / 5) + 10_000_000).cast("long").alias("b")), 3)


def contained_keys(spark, d):
    return cluster.contained(_keys(spark, d))


def gray_pairs(spark, d):
    return cluster.gray_pairs(_keys(spark, d))


def top_pairs(spark, d):
    return cluster.top_pairs(gray_pairs(spark, d), 2)


def candidate_batches(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("component"), "c_custkey")
    return cluster.batches(c, "c_custkey", 20).groupBy("component", "part").agg(F.count("*").alias("n"))


def linked_entities(spark, d):
    questions = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("in france and united states "), F.col("role")).alias("text"))
    entities = table(spark, d, "nation").select(F.col("n_nationkey").alias("entity_id"), F.lower("n_name").alias("key"), (F.col("n_regionkey") % 2).alias("priority"))
    extra = spark.createDataFrame([(100, "france", 0), (101, "united states", 1), (102, "user", 2), (103, "in", 0)], "entity_id int, key string, priority int")
    return cluster.linked_entities(questions, entities.where("lower(key) NOT IN ('france', 'united states')").unionByName(extra)).select("query_id", "entity_id", "key", "rank")


def consolidated_types(spark, d):
    return cluster.consolidated_types(table(spark, d, "part").select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("type")), ["LARGE", "no such"])


def section_chunks(spark, d):
    """Sections of pages as Markdown (rows only; the splitter is tested by itself)."""
    from quarrylake.sources import html

    pages = html.parsed(table(spark, d, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return chunking.sections(pages).select("doc_id", "idx", "title", "level", "start", "stop")


def question_words(spark, d):
    """Words of benchmark items that no document of the labelled ones has."""
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    labelled = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return asked.join(labelled, "term", "left_anti")


_FUNCTIONS = (truthy_cells, id_cells, json_answers, combined_filter, any_column_like, keyword_page, hydrated_hits, explained_hits, best_score_first_place, last_wins, assets_by_page, path_prefix, evidence_context, fallback_answers, provider_payloads, entity_components, entity_communities, contained_keys, gray_pairs, top_pairs, candidate_batches, linked_entities, consolidated_types, section_chunks, question_words)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
_TOK = R.TOKEN_SQL
_HITS = "h AS (SELECT conv_id AS query_id, turn + 1 AS rank, text FROM conversations)"
_GRAY = """g AS (SELECT key, gram, count(*) AS c FROM (SELECT key, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM (SELECT key, '  ' || regexp_replace(key, '\\s+', '', 'g') || '  ' AS p FROM k)) GROUP BY ALL),
    n AS (SELECT key, sqrt(sum(c * c)::DOUBLE) AS norm FROM g GROUP BY key),
    s AS (SELECT * FROM (SELECT a.key AS a_key, b.key AS b_key, round(sum(a.c * b.c)::DOUBLE / (x.norm * y.norm), 6) AS score FROM g a JOIN g b ON a.gram = b.gram AND a.key < b.key JOIN n x ON x.key = a.key JOIN n y ON y.key = b.key GROUP BY a.key, b.key, x.norm, y.norm) WHERE score >= 0.42::DOUBLE)"""
ORACLE = {
    "truthy_cells": "SELECT o_orderstatus, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS yes, count(*) AS n FROM orders GROUP BY 1",
    "id_cells": "SELECT o_orderkey, CASE WHEN o_custkey = o_orderkey % 7 THEN o_custkey::VARCHAR ELSE o_custkey || '|' || (o_orderkey % 7) END AS ids FROM orders",
    "json_answers": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events",
    "combined_filter": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey < 60 AND l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1",
    "any_column_like": "SELECT p_partkey FROM part WHERE p_name ILIKE '%widg%' OR p_brand ILIKE '%widg%' OR p_type ILIKE '%widg%' OR contains(p_brand, '#1_')",
    "keyword_page": rf"WITH h AS (SELECT doc_id FROM documents WHERE len(list_intersect({_TOK}, ['moron', 'idiot'])) > 0) SELECT doc_id AS chunk_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY doc_id LIMIT 5 OFFSET 5",
    "hydrated_hits": f"SELECT query_id, chunk_id, rank, lang FROM ({R._dense_sql('all', 10)}) JOIN documents ON doc_id = chunk_id WHERE doc_id % 2 = 0",
    "explained_hits": f"""WITH {R._CHANNELS_SQL}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM h GROUP BY ALL),
        r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM f) WHERE rank <= 5)
        SELECT r.query_id, r.chunk_id, r.rank, a.rank AS first_rank, a.score AS first_score, b.rank AS second_rank, b.score AS second_score FROM r LEFT JOIN h a ON a.query_id = r.query_id AND a.chunk_id = r.chunk_id AND a.retriever = 'bm25' LEFT JOIN h b ON b.query_id = r.query_id AND b.chunk_id = r.chunk_id AND b.retriever = 'dense'""",
    "best_score_first_place": "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS rank FROM (SELECT event_type AS query_id, event_id % 37 AS chunk_id, max(value) AS score, min(event_id) AS pos FROM events GROUP BY 1, 2)",
    "last_wins": "SELECT user_id AS key, min(event_id) AS pos, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "assets_by_page": "SELECT asset_id, string_agg(c::VARCHAR, ',' ORDER BY c) AS chunk_ids FROM (SELECT DISTINCT a.l_orderkey * 10 + a.l_linenumber AS asset_id, c.l_linenumber AS c FROM lineitem a JOIN lineitem c ON a.l_orderkey = c.l_orderkey AND (a.l_partkey % 4 = c.l_linenumber % 3)) GROUP BY 1",
    "evidence_context": f"WITH {_HITS} SELECT query_id, sha256(string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank)) AS context_sha256 FROM h GROUP BY 1",
    "fallback_answers": f"WITH {_HITS}, b AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS answer FROM h WHERE rank <= 3 AND length(trim(text)) >= 12 GROUP BY 1) SELECT query_id, sha256(coalesce(answer, '')) AS answer_sha256, CASE WHEN answer IS NULL THEN 'not_found' ELSE 'answered' END AS status FROM (SELECT DISTINCT query_id FROM h) LEFT JOIN b USING (query_id)",
    "provider_payloads": "SELECT event_id::VARCHAR AS chunk_id, event_type AS text, CASE WHEN event_id % 2 = 0 THEN event_id % 9 + 1 ELSE 1 END AS rank, CASE WHEN event_id % 2 = 0 THEN round(1.0::DOUBLE / (event_id % 9 + 1), 6) ELSE 0.5::DOUBLE END AS score FROM events",
    "entity_components": "WITH l AS (SELECT c_custkey AS a, (floor(c_acctbal / 5) + 10000000)::BIGINT AS b FROM customer), m AS (SELECT b, min(a) AS component FROM l GROUP BY b) SELECT a AS node, component FROM l JOIN m USING (b) UNION ALL SELECT b, component FROM m",
    "contained_keys": f"WITH {_KEYS}, w AS (SELECT key, list_distinct(string_split(key, ' ')) AS w FROM k), p AS (SELECT key, unnest(w) AS word FROM w) SELECT DISTINCT a.key AS small, b.key AS large FROM w a JOIN p pa ON pa.key = a.key JOIN p pb ON pb.word = pa.word JOIN w b ON b.key = pb.key WHERE a.key <> b.key AND len(b.w) - len(a.w) BETWEEN 0 AND 1 AND list_has_all(b.w, a.w)",
    "gray_pairs": f"WITH {_KEYS}, {_GRAY} SELECT * FROM s",
    "top_pairs": f"WITH {_KEYS}, {_GRAY}, t AS (SELECT a_key AS k, b_key AS o, score FROM s UNION ALL SELECT b_key, a_key, score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, o DESC) AS n FROM t) SELECT DISTINCT least(k, o) AS a_key, greatest(k, o) AS b_key, score FROM r WHERE n <= 2",
    "candidate_batches": "SELECT component, part, count(*) AS n FROM (SELECT c_nationkey AS component, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS part FROM customer) GROUP BY 1, 2",
    "consolidated_types": "SELECT canonical, type FROM (SELECT p_brand AS canonical, p_type AS type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'LARGE', count(*) DESC, p_type) AS n FROM part GROUP BY 1, 2) WHERE n = 1",
    "question_words": f"SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) WHERE term NOT IN (SELECT unnest({_TOK}) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
}
