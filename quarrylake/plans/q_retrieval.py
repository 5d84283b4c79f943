"""Retrieval queries: benchmark items as questions over documents, embeddings as dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.operators import evaluation, retrieval
from quarrylake.sources.tables import table

#: Retrieval channels of the fusion queries: every 20th vector asks, from two halves of its coordinates.
TOKEN_SQL = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')"


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_chunks(spark, d), _questions(spark, d), 10).select("query_id", "chunk_id", "score", "rank")


BM25_SQL = rf"""
WITH c AS (SELECT doc_id, {TOKEN_SQL} AS w FROM documents),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKEN_SQL}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM c) GROUP BY ALL),
t AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS avgdl FROM c),
df AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM p, t GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
s AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / avgdl))), 6) AS score
      FROM p JOIN q USING (term) JOIN idf USING (term) JOIN c USING (doc_id), t GROUP BY ALL HAVING score > 0)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10
"""


def sparse_top10(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse(_chunks(spark, d), _questions(spark, d), 10).select("query_id", "chunk_id", "score", "rank")


SPARSE_SQL = rf"""
WITH q AS (SELECT item_id AS query_id, unnest({TOKEN_SQL}) AS term FROM benchmark),
p AS (SELECT doc_id AS chunk_id, unnest({TOKEN_SQL}) AS term FROM documents),
s AS (SELECT query_id, chunk_id, sum(a * b)::DOUBLE AS score FROM (SELECT query_id, term, count(*) AS a FROM q GROUP BY ALL) JOIN (SELECT chunk_id, term, count(*) AS b FROM p GROUP BY ALL) USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10
"""


def _vectors(spark, d, part="all"):
    e = F.col("embedding")
    cut = {"all": e, "first": F.slice(e, 1, 32), "second": F.slice(e, 33, 32)}[part]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), cut.alias("embedding"))


def _asking(spark, d, part="all"):
    return _vectors(spark, d, part).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def dense_top10(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense(_vectors(spark, d), _asking(spark, d), 10).select("query_id", "chunk_id", "score", "rank")


def _cos(a, b):
    return f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6)"


def _dense_sql(part, k):
    cut = {"all": "embedding", "first": "embedding[1:32]", "second": "embedding[33:64]"}[part]
    return f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_cos("q." + cut, "c." + cut)} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"""


def _channels(spark, d, k=20):
    one = retrieval.dense(_vectors(spark, d, "first"), _asking(spark, d, "first"), k).withColumn("retriever", F.lit("bm25"))
    two = retrieval.dense(_vectors(spark, d, "second"), _asking(spark, d, "second"), k)
    return one.unionByName(two)


_CHANNELS_SQL = f"h AS (SELECT *, 'bm25' AS retriever FROM ({_dense_sql('first', 20)}) UNION ALL SELECT *, 'dense' FROM ({_dense_sql('second', 20)}))"
_TOP = "SELECT query_id, chunk_id, score, best_rank, retriever, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM f) WHERE rank <= 10"


def _fused(frame):
    return frame.select("query_id", "chunk_id", "score", "best_rank", "retriever", "rank")


def rrf_fusion(spark, d):
    return _fused(retrieval.rrf(_channels(spark, d), 10))


def weighted_rrf_fusion(spark, d):
    return _fused(retrieval.rrf(_channels(spark, d), 10, weights={"bm25": retrieval.BM25_WEIGHT, "dense": retrieval.DENSE_WEIGHT}))


def score_fusion(spark, d):
    return _fused(retrieval.score_fusion(_channels(spark, d), 10))


def rrf_contributions(spark, d):
    return retrieval.contributions(_channels(spark, d))


def threshold_filter(spark, d):
    """Every hit of both channels with its scaled score and why it goes."""
    return retrieval.thresholded(_channels(spark, d), 0.25, 0.2).select("query_id", "chunk_id", "retriever", "score", F.round("norm", 6).alias("norm"), "removed")


def evidence_floor(spark, d):
    return retrieval.evidence_floor(_channels(spark, d).where("score >= 0.3"), 6).select("query_id", "chunk_id", "retriever", "score")


def metadata_boost(spark, d):
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    hits = retrieval.dense(_vectors(spark, d), _asking(spark, d), 20).join(kinds, "chunk_id")
    factor = F.when(F.col("label") % 3 == 0, 1.5).when(F.col("label") % 3 == 1, 1.1).otherwise(retrieval.DUPLICATE_FACTOR)
    return retrieval.boosted(hits, factor, 10).select("query_id", "chunk_id", "score", "before", "rank")


def parent_collapse(spark, d):
    """Vectors stand for questions and their label for the parent."""
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("parent"))
    hits = retrieval.dense(_vectors(spark, d), _asking(spark, d), 40).join(kinds, "chunk_id")
    return retrieval.collapse_to_parent(hits, "parent", 5, 0.1).select("query_id", "chunk_id", "score", "rank")


def filter_with_fallback(spark, d):
    """Hits of the asking vector's own label, or all of them if there is none besides itself."""
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    asked = kinds.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("asked"))
    hits = retrieval.dense(_vectors(spark, d), _asking(spark, d), 10).where("query_id <> chunk_id").join(kinds, "chunk_id").join(asked, "query_id")
    return retrieval.filtered_or_all(hits.where("label = asked"), hits).select("query_id", "chunk_id", "score", "rank")


def hybrid_metrics(spark, d):
    """Recall, reciprocal rank, first truth rank and coverage of fused lists; truth is the asking vector's label."""
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    fused = retrieval.rrf(_channels(spark, d), 10)
    lists = fused.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    asked = kinds.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), "label")
    truth = asked.join(kinds, "label").groupBy("question_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("relevant"))
    return evaluation.metrics(lists.withColumnRenamed("query_id", "question_id").join(truth, "question_id"), 5)


def dense_by_blocks(spark, d):
    """The same ranking as ``dense_top10``, by the way of more questions than are sent."""
    return retrieval.dense(_vectors(spark, d), _asking(spark, d), 10, sent=0).select("query_id", "chunk_id", "score", "rank")


def fusion_selector(spark, d):
    """All three fusions of the same channels, by name."""
    hits, out = _channels(spark, d), None
    for method in retrieval.METHODS:
        one = retrieval.fuse(hits, 5, method).select("query_id", "chunk_id", "score", "rank").withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


#: Ids of vectors that are sent to all executors (some 50 bytes each in a hashed relation, so 100 MB at most).
VECTOR_IDS = 2_000_000


def _texts(spark, d):
    """Documents with the vector of the same number, and benchmark items with theirs, as chunks and questions."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    documents = table(spark, d, "documents")
    if vectors.count() <= VECTOR_IDS:  # texts without a vector end where they are read
        documents = documents.join(F.broadcast(vectors.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    chunks = documents.join(vectors, F.col("doc_id") == F.col("id")).select(F.col("doc_id").alias("chunk_id"), "text", "embedding", "label", "lang")
    questions = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), "text", "embedding")
    return chunks, questions


def hybrid_retrieve(spark, d):
    """Dense and sparse over English documents, fused, then the graph channel (here: dense on half vectors) in turn."""
    chunks, questions = _texts(spark, d)
    graph = retrieval.dense(chunks.withColumn("embedding", F.slice("embedding", 1, 32)), questions.withColumn("embedding", F.slice("embedding", 1, 32)), 10)
    return retrieval.hybrid(chunks, questions, 10, F.col("lang") == "en", [graph]).select("query_id", "chunk_id", "score", "rank")


def linear_retrieve(spark, d):
    chunks, questions = _texts(spark, d)
    return retrieval.retrieve(chunks, questions, 5, 20, {"bm25": (1.0, 0.1), "dense": (0.05, None)}, 0.015).select("query_id", "chunk_id", "score", "rank")


def stage_thresholds(spark, d):
    """Fused hits with why they go: score, place, or too little evidence."""
    fused = retrieval.rrf(_channels(spark, d), 15)
    return retrieval.cut(fused, 8, 0.017, 6).select("query_id", "chunk_id", "rank", "removed")


def type_boost(spark, d):
    """Factors of document and question types, and of duplicate candidates."""
    kinds = F.array(*map(F.lit, ("faq", "manual", "article", "spec_sheet", "policy", "unknown", "other")))
    hits = retrieval.dense(_vectors(spark, d), _asking(spark, d), 20)
    doc, asked = F.element_at(kinds, (F.col("chunk_id") % 7 + 1).cast("int")), F.element_at(kinds, (F.col("query_id") / 20 % 7 + 1).cast("int"))
    factor = retrieval.type_factor(doc, asked) * retrieval.duplicate_factor(F.when(F.col("chunk_id") % 5 == 0, "duplicate_candidate"))
    return retrieval.boosted(hits, factor, 10).select("query_id", "chunk_id", "score", "before", "rank")


def fan_out_merge(spark, d):
    """Each asking vector's halves as sub-queries."""
    halves = [retrieval.dense(_vectors(spark, d, p), _asking(spark, d, p), 10).withColumn("sub", F.lit(n)) for n, p in enumerate(("first", "second"))]
    return retrieval.merged_fan_out(halves[0].unionByName(halves[1])).select("query_id", "chunk_id", "score", "rank")


def fresh_results(spark, d):
    """Hits of both channels, each chunk once where it comes first."""
    return retrieval.fresh_only(_channels(spark, d).withColumn("sub", F.col("query_id") % 1)).select("query_id", "chunk_id", "retriever", "rank")


def score_rerank(spark, d):
    fused = retrieval.rrf(_channels(spark, d), 15).withColumn("score", F.round(F.col("score") * (1 + F.col("chunk_id") % 3), 9))
    return retrieval.rerank_by_score(fused, 6).select("query_id", "chunk_id", "score", "before", "rank")


def model_rerank(spark, d):
    """A stand-in scorer (lengths in common); the shortest questions make it fail, so their scores decide."""

    def scorer(pairs):
        return [-abs(len(q) - len(t)) for q, t in pairs]

    chunks, questions = _texts(spark, d)
    hits = retrieval.dense(chunks, questions, 10).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    return retrieval.reranked(hits, 5, scorer).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "reranker")


def provider_order(spark, d):
    """Places as a provider might return them: last first, cut to three."""
    hits = retrieval.dense(_vectors(spark, d), _asking(spark, d), 6)
    orders = _asking(spark, d).select("query_id", F.array(*map(F.lit, (5, 0, 3, 1))).alias("indices"))
    return retrieval.reordered_by_provider(hits, orders, 3).select("query_id", "chunk_id", "rank")


def query_words(spark, d):
    q = retrieval.preprocessed(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text"))
    return q.select("query_id", F.sha2("normalized", 256).alias("normalized_sha256"), F.size("tokens").cast("long").alias("n"))


def recency(spark, d):
    """Decay of orders' dates at a fixed day, between 0.9 and 1; dates that don't parse count as new."""
    date = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    age = retrieval.age_days(date, F.to_timestamp(F.lit("1999-01-01 00:00:00")))
    return table(spark, d, "orders").select("o_orderkey", F.round(retrieval.recency_factor(age, 0.9, 1.0), 6).alias("factor"))


_DENSE20 = _dense_sql("all", 20)
QUERIES = {"bm25_top10": bm25_top10, "sparse_top10": sparse_top10, "dense_top10": dense_top10, "rrf_fusion": rrf_fusion, "weighted_rrf_fusion": weighted_rrf_fusion, "score_fusion": score_fusion, "rrf_contributions": rrf_contributions, "threshold_filter": threshold_filter, "evidence_floor": evidence_floor, "metadata_boost": metadata_boost, "parent_collapse": parent_collapse, "filter_with_fallback": filter_with_fallback, "hybrid_metrics": hybrid_metrics}
QUERIES |= {f.__name__: f for f in (dense_by_blocks, fusion_selector, hybrid_retrieve, linear_retrieve, stage_thresholds, type_boost, fan_out_merge, fresh_results, score_rerank, model_rerank, provider_order, query_words, recency)}
ORACLE = {
    "bm25_top10": BM25_SQL,
    "sparse_top10": SPARSE_SQL,
    "dense_top10": _dense_sql("all", 10),
    "rrf_fusion": f"WITH {_CHANNELS_SQL}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retriever FROM h GROUP BY ALL) {_TOP}",
    "weighted_rrf_fusion": f"WITH {_CHANNELS_SQL}, f AS (SELECT query_id, chunk_id, round(sum((CASE retriever WHEN 'bm25' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END) / (60 + rank)), 9) AS score, min(rank) AS best_rank, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retriever FROM h GROUP BY query_id, chunk_id) {_TOP}",
    "score_fusion": f"WITH {_CHANNELS_SQL}, n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM h WINDOW w AS (PARTITION BY query_id, retriever)), f AS (SELECT query_id, chunk_id, round(sum((CASE retriever WHEN 'bm25' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END) * norm), 9) AS score, min(rank) AS best_rank, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retriever FROM n GROUP BY query_id, chunk_id) {_TOP}",
    "rrf_contributions": f"WITH {_CHANNELS_SQL} SELECT query_id, chunk_id, retriever, rank, score, round(1.0::DOUBLE / (60 + rank), 9) AS contribution FROM h",
    "threshold_filter": f"WITH {_CHANNELS_SQL}, n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM h WINDOW w AS (PARTITION BY query_id, retriever)) SELECT query_id, chunk_id, retriever, score, round(norm, 6) AS norm, CASE WHEN score < 0.25 THEN 'min_score' WHEN norm < 0.2 THEN 'min_norm_score' END AS removed FROM n",
    "evidence_floor": f"WITH {_CHANNELS_SQL} SELECT query_id, chunk_id, retriever, score FROM h WHERE score >= 0.3 QUALIFY count(*) OVER (PARTITION BY query_id) >= 6",
    "metadata_boost": f"""WITH h AS ({_DENSE20}), b AS (SELECT query_id, chunk_id, rank AS before, round((CASE WHEN count(*) OVER w = 1 THEN score ELSE (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE max(score) OVER w - min(score) OVER w END) END)
        * least(greatest(CASE label % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 0.8::DOUBLE END, 0.7::DOUBLE), 1.4::DOUBLE), 9) AS score FROM h JOIN embeddings ON vec_id = chunk_id WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, chunk_id, score, before, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM b) WHERE rank <= 10""",
    "parent_collapse": f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, label::BIGINT AS chunk_id, max(score) AS score FROM ({_dense_sql('all', 40)}) JOIN embeddings ON vec_id = chunk_id WHERE score >= 0.1 GROUP BY ALL)) WHERE rank <= 5",
    "filter_with_fallback": f"WITH h AS (SELECT h.*, c.label AS label, q.label AS asked FROM ({_dense_sql('all', 10)}) h JOIN embeddings c ON c.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id WHERE query_id <> chunk_id) SELECT query_id, chunk_id, score, rank FROM h WHERE label = asked OR NOT EXISTS (SELECT 1 FROM h x WHERE x.query_id = h.query_id AND x.label = x.asked)",
    "hybrid_metrics": f"""WITH {_CHANNELS_SQL}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM h GROUP BY ALL),
        r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM f) WHERE rank <= 10),
        t AS (SELECT q.vec_id AS question_id, x.vec_id AS chunk_id FROM embeddings q JOIN embeddings x USING (label) WHERE q.vec_id % 20 = 0),
        j AS (SELECT question_id, count(*) AS n, count(*) FILTER (rank <= 5) AS hits, min(rank) AS truth_rank FROM t LEFT JOIN r ON query_id = question_id AND r.chunk_id = t.chunk_id GROUP BY ALL)
        SELECT question_id, round(hits::DOUBLE / n, 6) AS recall, round(CASE WHEN truth_rank <= 5 THEN 1.0::DOUBLE / truth_rank ELSE 0.0::DOUBLE END, 6) AS rr, truth_rank, CASE WHEN hits = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM j""",
}

_RRF = "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM {} GROUP BY ALL"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank FROM ({})"
_CT = "c AS (SELECT doc_id AS chunk_id, text, embedding, lang FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT item_id AS query_id, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"


def _dense_of(cut, k, where="true"):
    a, b = (f"{t}.embedding{cut}" for t in "qc")
    return f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {_cos(a, b)} AS score FROM q, c WHERE {where})) WHERE rank <= {k}"


_SPARSE_OF = rf"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(a * b)::DOUBLE AS score
    FROM (SELECT query_id, term, count(*) AS a FROM (SELECT query_id, unnest({TOKEN_SQL}) AS term FROM q) GROUP BY ALL) JOIN (SELECT chunk_id, term, count(*) AS b FROM (SELECT chunk_id, unnest({TOKEN_SQL}) AS term FROM c WHERE lang = 'en') GROUP BY ALL) USING (term) GROUP BY ALL)) WHERE rank <= 10"""
_BM25_OF = BM25_SQL.replace("WITH c AS (SELECT doc_id, ", f"WITH {_CT.replace('c AS', 'cc AS').replace('q AS', 'qq AS')}, c AS (SELECT chunk_id AS doc_id, ").replace(" AS w FROM documents)", " AS w FROM cc)").replace("SELECT item_id AS query_id, unnest(", "SELECT query_id, unnest(").replace("FROM benchmark)", "FROM qq)").replace("rank <= 10", "rank <= 20")
ORACLE |= {
    "dense_by_blocks": _dense_sql("all", 10),
    "fusion_selector": " UNION ALL ".join(f"SELECT query_id, chunk_id, score, rank, '{m}' AS method FROM ({ORACLE[n]}) WHERE rank <= 5" for m, n in (("rrf", "rrf_fusion"), ("weighted_rrf", "weighted_rrf_fusion"), ("normalized_score", "score_fusion"))),
    "hybrid_retrieve": f"""WITH {_CT}, h AS (SELECT * FROM ({_dense_of('', 10, "lang = 'en'")}) UNION ALL SELECT * FROM ({_SPARSE_OF})),
        f AS (SELECT * FROM ({_RANKED.format(_RRF.format('h'))}) WHERE rank <= 10),
        g AS (SELECT query_id, chunk_id, score, rank FROM f UNION ALL SELECT * FROM ({_dense_of('[1:32]', 10)}))
        SELECT query_id, chunk_id, score, rank FROM ({_RANKED.format(_RRF.format('g'))}) WHERE rank <= 10""",
    "linear_retrieve": f"""WITH {_CT}, h AS (SELECT *, 'bm25' AS retriever FROM ({_BM25_OF}) UNION ALL SELECT *, 'dense' FROM ({_dense_of('', 20)})),
        n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM h WINDOW w AS (PARTITION BY query_id, retriever)),
        k AS (SELECT * FROM n WHERE CASE WHEN retriever = 'bm25' THEN score >= 1.0 AND norm >= 0.1::DOUBLE ELSE score >= 0.05::DOUBLE END),
        f AS (SELECT * FROM ({_RANKED.format(_RRF.format('k'))}) WHERE rank <= 20 AND score >= 0.015::DOUBLE)
        SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f) WHERE rank <= 5""",
    "stage_thresholds": f"""WITH {_CHANNELS_SQL}, f AS (SELECT * FROM ({_RANKED.format(_RRF.format('h'))}) WHERE rank <= 15),
        m AS (SELECT *, CASE WHEN score < 0.017::DOUBLE THEN 'min_score' WHEN sum(CASE WHEN score < 0.017::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank) > 8 THEN 'top_k' END AS r FROM f)
        SELECT query_id, chunk_id, rank, CASE WHEN r IS NULL AND count(*) FILTER (r IS NULL) OVER (PARTITION BY query_id) < 6 THEN 'min_evidence_count' ELSE r END AS removed FROM m""",
    "fan_out_merge": f"""WITH h AS (SELECT *, 0 AS sub FROM ({_dense_sql('first', 5)}) UNION ALL SELECT *, 1 FROM ({_dense_sql('second', 5)})),
        o AS (SELECT query_id, chunk_id, max(score) AS score, min({{'sub': sub, 'place': rank}}) AS first FROM h GROUP BY ALL)
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM o""",
    "fresh_results": f"WITH {_CHANNELS_SQL} SELECT query_id, chunk_id, retriever, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retriever <> 'bm25', rank) = 1",
    "score_rerank": f"""WITH {_CHANNELS_SQL}, f AS (SELECT query_id, chunk_id, round(score * (1 + chunk_id % 3), 9) AS score, rank AS before FROM ({_RANKED.format(_RRF.format('h'))}) WHERE rank <= 15)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS rank FROM f) WHERE rank <= 6""",
    "model_rerank": f"""WITH {_CT}, h AS ({_dense_of('', 10)}), s AS (SELECT h.query_id, h.chunk_id, -abs(length(q.text) - length(c.text))::DOUBLE AS score, h.rank AS before FROM h JOIN q USING (query_id) JOIN c USING (chunk_id))
        SELECT query_id, chunk_id, score, rank, 'model' AS reranker FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS rank FROM s) WHERE rank <= 5""",
    "provider_order": f"SELECT query_id, chunk_id, CASE rank WHEN 6 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank FROM ({_dense_sql('all', 6)}) WHERE rank IN (6, 1, 4)",
    "query_words": rf"SELECT conv_id * 100 + turn AS query_id, sha256(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))) AS normalized_sha256, len({TOKEN_SQL})::BIGINT AS n FROM conversations",
    "recency": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE + 0.1::DOUBLE * exp(-floor((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 86400) * ln(2.0::DOUBLE) / 90) END, 6) AS factor FROM orders",
    "type_boost": f"""WITH h AS ({_DENSE20}), m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for a, t in retrieval.TYPE_FACTORS.items() for b, v in t.items())}) AS t(asked, doc, factor)),
        a AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {v}::DOUBLE)" for b, v in retrieval.ANY_TYPE.items())}) AS t(doc, factor)),
        k AS (SELECT *, ['faq', 'manual', 'article', 'spec_sheet', 'policy', 'unknown', 'other'][(chunk_id % 7 + 1)::INT] AS doc, ['faq', 'manual', 'article', 'spec_sheet', 'policy', 'unknown', 'other'][(query_id // 20 % 7 + 1)::INT] AS asked FROM h),
        w AS (SELECT k.*, coalesce(CASE WHEN k.asked IN ('unknown', 'other') THEN a.factor ELSE m.factor END, 1.0::DOUBLE) * CASE WHEN chunk_id % 5 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM k LEFT JOIN m ON m.asked = k.asked AND m.doc = k.doc LEFT JOIN a ON a.doc = k.doc),
        b AS (SELECT query_id, chunk_id, rank AS before, round((score - min(score) OVER p) / (CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0::DOUBLE ELSE max(score) OVER p - min(score) OVER p END) * least(greatest(factor, 0.7::DOUBLE), 1.4::DOUBLE), 9) AS score FROM w WINDOW p AS (PARTITION BY query_id))
        SELECT query_id, chunk_id, score, before, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM b) WHERE rank <= 10""",
}
