"""Duplicate, quality and text-analytics queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import chunking, dedup, quality
from quarrylake.sources.tables import table

_NORM = r"lower(trim(regexp_replace(regexp_replace(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g')))"
_FOLD = r"trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'))"
_KEY = r"trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("pos"), "embedding")


def dedup_exact(spark, d):
    return dedup.exact_matches(_chunks(spark, d)).drop("distance")


def dedup_simhash(spark, d):
    return dedup.simhash_matches(_chunks(spark, d))


def dedup_embedding(spark, d):
    return dedup.embedding_matches(_vectors(spark, d), 0.4).select("canonical_id", "duplicate_id", "layer", "score")


def dedup_cascade(spark, d):
    """All three layers; vectors stand for the documents of the same number."""
    return dedup.cascade(_chunks(spark, d), _vectors(spark, d), threshold=0.5)


def dedup_metadata(spark, d):
    return dedup.duplicate_metadata(dedup.exact_matches(_chunks(spark, d)))


def dedup_counters(spark, d):
    return dedup.counters(dedup.exact_matches(_chunks(spark, d)))


def dedup_review_page(spark, d):
    return dedup.review_page(dedup.exact_matches(_chunks(spark, d)), 50, 10).drop("distance")


def dedup_incremental(spark, d):
    c = _chunks(spark, d)
    return dedup.incremental_exact(c.where("pos % 3 <> 0"), c.where("pos % 3 = 0"))


def quality_exact_groups(spark, d):
    return quality.exact_groups(_chunks(spark, d))


def quality_near_duplicates(spark, d):
    return quality.near_duplicates(_chunks(spark, d))


def quality_facts(spark, d):
    """Numbers with units, for every first word of a document as the entity pattern of this corpus."""
    return quality.facts(_chunks(spark, d), r"\b(?:the|der|les?|los)\b", (("amount", r"(?P<n>\d[\d.,]*)\s*(?P<u>[a-z]+)\b"),)).select("chunk_id", "entity", "attribute", "value", "norm", "unit", "start", "stop")


def quality_numeric_conflicts(spark, d):
    found = table(spark, d, "lineitem").select(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("entity"), F.lit("tax").alias("attribute"), F.col("l_returnflag").alias("unit"), F.col("l_tax").alias("norm"), F.col("l_orderkey").alias("chunk_id"))
    return quality.numeric_conflicts(found)


def claim_conflicts(spark, d):
    s = table(spark, d, "supplier")
    claims = s.select(F.col("s_suppkey").alias("chunk_id"), F.lit("nation").alias("attribute"), F.col("s_nationkey").cast("string").alias("entity"), F.floor(F.col("s_acctbal") / 1000).cast("string").alias("value"), F.lit("1").alias("version"), F.when(F.col("s_suppkey") % 2 == 0, "2020").alias("effective_date"), F.array((F.col("s_suppkey") - 1).cast("string")).alias("supersedes"))
    return quality.claim_conflicts(claims)


def text_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("fold_sha256"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.substring(T.short_id("doc_", F.col("text")), 1, 16).alias("short_id"))


def text_sentences(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


def text_language_marks(spark, d):
    """A rule on letters: German sharp s and umlauts, French and Spanish marks, else English."""
    low = F.lower(F.col("text"))
    lang = F.when(low.rlike("[ßäü]"), "de").when(low.rlike("[èêçœ]"), "fr").when(low.rlike("[ñóí]"), "es").otherwise("en")
    return table(spark, d, "documents").select("doc_id", lang.alias("lang_rule"), (lang == F.col("lang")).alias("agrees"))


def text_paragraphs(spark, d):
    return chunking.paragraphs(table(spark, d, "documents")).select("doc_id", F.col("idx").cast("long").alias("idx"), F.sha2("chunk", 256).alias("chunk_sha256"), F.col("tokens").cast("long").alias("tokens"))


def text_token_groups(spark, d):
    parts = chunking.paragraphs(table(spark, d, "documents"), 0).where("length(chunk) > 0")
    return chunking.token_groups(parts).select("doc_id", F.col("part").cast("long").alias("part"), "paragraphs", F.col("tokens").cast("long").alias("tokens"), F.col("first_idx").cast("long").alias("first_idx"))


def text_windows(spark, d):
    return chunking.windows(table(spark, d, "documents")).select("doc_id", "idx", "start", "stop", F.sha2("chunk", 256).alias("chunk_sha256"))


def text_packed(spark, d):
    return chunking.packed(table(spark, d, "documents")).select("doc_id", "idx", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def term_frequency(spark, d):
    """Words with their uses and documents.  Where ids are unique a word's documents are counted in each text, so both counts
    are combined before the shuffle; distinct ids would shuffle every word of every document."""
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.select("doc_id", F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 20")
    each = lambda words, n, docs: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(n).alias("n"), F.lit(docs).alias("docs")))
    spread = docs.select(F.col("doc_id").isNotNull().alias("known"), F.explode(F.concat(each(F.col("words"), 1, 0), each(F.array_distinct("words"), 0, 1))).alias("w"))
    return spread.groupBy("w.term").agg(F.sum("w.n").alias("n"), F.sum(F.when(F.col("known"), F.col("w.docs")).otherwise(0)).alias("docs")).where("n >= 20")


def count_histogram(spark, d):
    sized = table(spark, d, "documents").select((F.floor(F.size(T.tokens(F.col("text"))) / 50) * 50).cast("long").alias("bucket"))
    counted = sized.groupBy("bucket").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


def singleton_terms(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    n = F.col("n")
    size = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")
    return words.groupBy("term").agg(F.count("*").alias("n")).groupBy(size.alias("size")).agg(F.count("*").alias("terms"), F.sum("n").alias("uses"))


def keyword_overlap(spark, d):
    """Of each source's documents: how many contain a word of the benchmark as a token."""
    heads = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    words = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return words.join(heads, "term").groupBy("source", "term").agg(F.count("*").alias("docs"))


def dedup_incremental_all(spark, d):
    """Every third document arrives after the others: exact and SimHash layers."""
    c = _chunks(spark, d)
    return dedup.incremental(c.where("pos % 3 <> 0"), c.where("pos % 3 = 0"))


def dedup_nearest_elsewhere(spark, d):
    """Every 20th vector arrives; vectors of one label are one document."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")
    return dedup.nearest_elsewhere(v, v.where("chunk_id % 20 = 0"), 0.1)


def dedup_embedding_cells(spark, d):
    """Approximate (recall measured in the tests), at the default threshold."""
    v = _vectors(spark, d)
    noisy = v.withColumn("chunk_id", F.col("chunk_id") + 1_000_000).withColumn("pos", F.col("chunk_id")).withColumn("embedding", F.transform("embedding", lambda x, i: (x + 0.02 * F.sin(i.cast("double"))).cast("float")))
    return dedup.embedding_cell_matches(v.unionByName(noisy)).select("canonical_id", "duplicate_id", "layer", "score")


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50).alias("chunk_index"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7).alias("created_at"))


def dedup_canonical_order(spark, d):
    refs = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return dedup.canonical_positions(_documents(spark, d), refs).select("chunk_id", "pos")


def dedup_attached(spark, d):
    c = _documents(spark, d).withColumn("pos", F.col("chunk_id")).withColumn("deduplication", F.lit("stale"))
    return dedup.attached(c, dedup.exact_matches(c)).select("chunk_id", "deduplication.status", "deduplication.primary_layer", "deduplication.canonical_id")


def dedup_backfill(spark, d):
    """Flags as of the exact layer of even documents only; those that change come out."""
    c = _documents(spark, d).withColumn("pos", F.col("chunk_id"))
    flagged = dedup.attached(c, dedup.exact_matches(c.where("chunk_id % 2 = 0")))
    return dedup.backfilled(flagged).select("chunk_id", "deduplication.layers", "deduplication.canonical_id")


def _index(spark, d):
    c = _documents(spark, d).withColumn("pos", F.col("chunk_id"))
    return dedup.resolved(dedup.exact_matches(c), c.where("chunk_id % 5 <> 1"))


def dedup_resolved(spark, d):
    return _index(spark, d).select("id", "duplicate_document", "canonical_document", F.sha2("canonical_text", 256).alias("canonical_sha256"))


def dedup_index_sync(spark, d):
    """Candidates of two sources replaced by nothing, those of a third gone from either side."""
    index = _index(spark, d)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    return dedup.without_documents(dedup.replaced(index, index.limit(0), ids("src0", "src1")), ids("src2")).select("id", "duplicate_document", "canonical_document")


def dedup_flagged(spark, d):
    return dedup.flagged_by_layer(dedup.exact_matches(_chunks(spark, d))).select("layer", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"), F.size("ids").cast("long").alias("n"))


def dedup_review_filter(spark, d):
    """Rows of the exact layer whose texts have a folded needle."""
    rows = _index(spark, d).withColumn("review_status", F.when(F.col("duplicate_id") % 2 == 0, "open")).withColumn("status", F.lit("pending")).withColumn("source_type", F.lit("url"))
    return rows.where(dedup.review_filter("EXACT_sha256", "open", "url", "É")).select("id")


QUERIES = {f.__name__: f for f in (dedup_exact, dedup_simhash, dedup_embedding, dedup_cascade, dedup_metadata, dedup_counters, dedup_review_page, dedup_incremental, quality_exact_groups, quality_near_duplicates, quality_facts, quality_numeric_conflicts, claim_conflicts, text_fold, text_sentences, text_language_marks, text_paragraphs, text_token_groups, text_windows, text_packed, term_frequency, count_histogram, singleton_terms, keyword_overlap, dedup_incremental_all, dedup_nearest_elsewhere, dedup_embedding_cells, dedup_canonical_order, dedup_attached, dedup_backfill, dedup_resolved, dedup_index_sync, dedup_flagged, dedup_review_filter)}
_EXACT = f"SELECT min(doc_id) OVER (PARTITION BY {_NORM}) AS canonical_id, doc_id AS duplicate_id FROM documents QUALIFY canonical_id <> duplicate_id"
_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')"
_LINES = r"SELECT doc_id, idx - 1 AS idx, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents)"
ORACLE = {
    "dedup_exact": f"SELECT *, 'exact_sha256' AS layer, 1.0::DOUBLE AS score FROM ({_EXACT})",
    "dedup_embedding": """SELECT * FROM (SELECT a.vec_id AS canonical_id, b.vec_id AS duplicate_id, 'embedding' AS layer,
        round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= 0.4""",
    "dedup_metadata": f"SELECT duplicate_id AS chunk_id, 'exact_sha256' AS layers, 'exact_sha256' AS primary_layer, canonical_id, 1::BIGINT AS match_count, canonical_id::VARCHAR || '::' || duplicate_id::VARCHAR AS group_id FROM ({_EXACT})",
    "dedup_counters": f"SELECT count(*) AS n, count(DISTINCT duplicate_id) AS chunks, count(*) AS n_exact_sha256, 0::BIGINT AS n_simhash, 0::BIGINT AS n_embedding, count(DISTINCT duplicate_id) AS chunks_exact_sha256, 0::BIGINT AS chunks_simhash, 0::BIGINT AS chunks_embedding FROM ({_EXACT})",
    "dedup_review_page": f"SELECT *, 'exact_sha256' AS layer, 1.0::DOUBLE AS score FROM ({_EXACT}) ORDER BY canonical_id, duplicate_id LIMIT 50 OFFSET 10",
    "dedup_incremental": f"SELECT canonical_id, doc_id AS duplicate_id FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {_NORM} ORDER BY doc_id % 3 = 0, doc_id) AS canonical_id FROM documents) WHERE doc_id % 3 = 0 AND doc_id <> canonical_id",
    "quality_exact_groups": f"SELECT sha256(k) AS group_id, count(*) AS n, min(doc_id) AS first_chunk FROM (SELECT doc_id, {_KEY} AS k FROM documents) WHERE k <> '' GROUP BY k HAVING count(*) > 1",
    "quality_near_duplicates": rf"""WITH c AS (SELECT min(doc_id) AS id, k FROM (SELECT doc_id, {_KEY} AS k FROM documents) WHERE k <> '' GROUP BY k),
        w AS (SELECT id, string_split(k, ' ') AS w FROM c),
        g AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
        SELECT left_id, right_id, score FROM (SELECT left_id, right_id, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS score FROM p JOIN n x ON x.id = left_id JOIN n y ON y.id = right_id) WHERE score >= 0.55""",
    "quality_numeric_conflicts": """WITH v AS (SELECT 'part' || l_partkey AS entity, l_returnflag AS unit, l_tax AS norm, min(l_orderkey) AS chunk_id, count(DISTINCT l_orderkey) AS chunks FROM lineitem GROUP BY ALL)
        SELECT a.entity, 'tax' AS attribute, a.unit, a.norm AS low_value, b.norm AS high_value, a.chunk_id AS low_chunk, b.chunk_id AS high_chunk, a.chunks AS low_chunks, b.chunks AS high_chunks
        FROM v a JOIN v b ON a.entity = b.entity AND a.unit = b.unit AND a.norm < b.norm WHERE abs(a.norm - b.norm) > greatest(abs(a.norm), abs(b.norm), 1.0::DOUBLE) * 0.01::DOUBLE""",
    "claim_conflicts": """WITH c AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS entity, trim(regexp_replace(floor(s_acctbal / 1000)::BIGINT::VARCHAR, '[^a-z0-9]+', ' ', 'g')) AS value, CASE WHEN s_suppkey % 2 = 0 THEN '2020' END AS eff FROM supplier)
        SELECT a.id AS left_id, b.id AS right_id, a.entity, 'nation' AS attribute, CASE WHEN a.eff IS DISTINCT FROM b.eff THEN 'temporal' ELSE 'entity_relation' END AS kind
        FROM c a JOIN c b ON a.entity = b.entity AND a.id < b.id WHERE a.value <> b.value AND a.id <> b.id - 1""",
    "text_fold": rf"SELECT doc_id, sha256({_FOLD}) AS fold_sha256, len({_TOK})::BIGINT AS n_tokens, 'doc_' || substr(sha256(text), 1, 12) AS short_id FROM documents",
    "text_sentences": r"SELECT doc_id, len(s)::BIGINT AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::BIGINT AS longest FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)",
    "text_language_marks": "SELECT doc_id, l AS lang_rule, l = lang AS agrees FROM (SELECT *, CASE WHEN regexp_matches(lower(text), '[ßäü]') THEN 'de' WHEN regexp_matches(lower(text), '[èêçœ]') THEN 'fr' WHEN regexp_matches(lower(text), '[ñóí]') THEN 'es' ELSE 'en' END AS l FROM documents)",
    "text_paragraphs": rf"SELECT doc_id, idx, sha256(chunk) AS chunk_sha256, len(string_split(chunk, ' '))::BIGINT AS tokens FROM ({_LINES}) WHERE (length(chunk) >= 40 OR regexp_matches(chunk, '[0-9]')) AND chunk <> ''",
    "text_token_groups": rf"""SELECT doc_id, part, count(*) AS paragraphs, sum(tokens)::BIGINT AS tokens, min(idx) AS first_idx FROM (SELECT *, floor((sum(tokens) OVER (PARTITION BY doc_id ORDER BY idx) - tokens) / 512)::BIGINT AS part
        FROM (SELECT doc_id, idx, len(string_split(chunk, ' ')) AS tokens FROM ({_LINES}) WHERE chunk <> '')) GROUP BY ALL""",
    "term_frequency": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term HAVING n >= 20",
    "count_histogram": f"SELECT bucket, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM (SELECT (len({_TOK}) // 50 * 50)::BIGINT AS bucket, count(*) AS n FROM documents GROUP BY 1)",
    "singleton_terms": f"SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS size, count(*) AS terms, sum(n)::BIGINT AS uses FROM (SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term) GROUP BY 1",
    "keyword_overlap": f"SELECT source, term, count(*) AS docs FROM (SELECT DISTINCT doc_id, source, unnest({_TOK}) AS term FROM documents) WHERE term IN (SELECT unnest({_TOK}) FROM benchmark) GROUP BY ALL",
}
_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
_ROWS = f"SELECT canonical_id, duplicate_id, b.source AS duplicate_document, b.text AS duplicate_text, a.source AS canonical_document, coalesce(left(a.text, 200), '') AS canonical_text, CASE WHEN a.source IS NULL THEN 'missing' ELSE canonical_id::VARCHAR END || '::' || duplicate_id || '::exact_sha256' AS id FROM ({_EXACT}) JOIN documents b ON b.doc_id = duplicate_id AND b.doc_id % 5 <> 1 LEFT JOIN documents a ON a.doc_id = canonical_id AND a.doc_id % 5 <> 1"
ORACLE |= {
    "dedup_nearest_elsewhere": f"SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 20 = 0) WHERE score >= 0.1) WHERE rank <= 5",
    "dedup_canonical_order": "SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM labels), doc_id % 4 = 0, CASE WHEN doc_id % 4 > 0 THEN doc_id % 7 END NULLS FIRST, source, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 ELSE 1000000 END, doc_id) AS pos FROM documents",
    "dedup_attached": f"SELECT doc_id AS chunk_id, CASE WHEN canonical_id IS NOT NULL THEN 'duplicate_candidate' END AS status, CASE WHEN canonical_id IS NOT NULL THEN 'exact_sha256' END AS primary_layer, canonical_id FROM documents LEFT JOIN ({_EXACT}) ON duplicate_id = doc_id",
    "dedup_resolved": f"SELECT id, duplicate_document, canonical_document, sha256(canonical_text) AS canonical_sha256 FROM ({_ROWS})",
    "dedup_index_sync": f"SELECT id, duplicate_document, canonical_document FROM ({_ROWS}) WHERE duplicate_document NOT IN ('src0', 'src1', 'src2') AND coalesce(canonical_document, '') <> 'src2'",
    "dedup_flagged": f"SELECT 'exact_sha256' AS layer, sha256(string_agg(duplicate_id::VARCHAR, ',' ORDER BY duplicate_id)) AS ids_sha256, count(*) AS n FROM ({_EXACT})",
    "dedup_review_filter": f"SELECT id FROM ({_ROWS}) WHERE duplicate_id % 2 = 0 AND (contains(strip_accents(lower(left(duplicate_text, 200))), 'e') OR contains(strip_accents(lower(canonical_text)), 'e'))",
}
