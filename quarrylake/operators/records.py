"""Record-level operators: predicates, JSON recovery, coercions, joins of results with their stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T

TRUE_WORDS = ("1", "true", "yes", "y", "x", "on")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def id_list(c: Column) -> Column:
    """Ids of a comma-separated cell, in order, each once; NONE and blanks are none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.upper(x) != "NONE")))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer: without code fences, whole or from the first to the last brace; null if none."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^```\w*\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    return F.when(valid(bare), bare).when((inner != "") & valid(inner), inner)


def allowed(document: Column, ids: list | None, layer: Column, dropped: list[str], entities: Column | None = None, wanted: list[str] | None = None) -> Column:
    """Combined filter: documents in a list (none given: all), no dropped duplicate layer, some wanted entity.

    Rows without a layer pass, as do all rows where nothing is wanted.
    """
    out = F.lit(True) if ids is None else document.isin(ids)
    if dropped:
        out = out & ~F.coalesce(layer.isin(dropped), F.lit(False))
    if entities is not None and wanted:
        out = out & F.coalesce(F.arrays_overlap(entities, F.array(*map(F.lit, wanted))), F.lit(False))
    return out


def any_like(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring over several columns; wildcards in the needle are plain characters."""
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.ilike(F.col(c), F.lit(pattern)), F.lit(False))
    return out


def keyword_page(chunks: DataFrame, keywords: str, page: int, size: int) -> DataFrame:
    """A page (from 1) of the chunks that share a folded word with the keywords, with the total over all pages."""
    words = T.tokens(F.lit(keywords))
    hit = chunks.where((F.size(words) == 0) | F.arrays_overlap(T.tokens(F.col("text")), words))
    total = hit.agg(F.count("*").alias("total"))
    rows = hit.orderBy("pos").offset((max(1, page) - 1) * size).limit(size)
    return rows.join(F.broadcast(total))


def usable_evidence(hits: DataFrame, least: int = 12) -> DataFrame:
    """Evidence by rank, without texts that are too short to say anything."""
    return hits.where(F.length(F.trim("text")) >= least)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their texts; ranks stay as they were, so chunks that are gone leave gaps."""
    one = chunks.dropDuplicates(["chunk_id"])
    return hits.join(one, "chunk_id")


def explained(final: DataFrame, **stages: DataFrame) -> DataFrame:
    """Final hits with each stage's rank and score for the same chunk."""
    out = final
    for name, stage in stages.items():
        out = out.join(stage.select("query_id", "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")), ["query_id", "chunk_id"], "left")
    return out


def best_score_first_place(hits: DataFrame) -> DataFrame:
    """Of repeated chunks the best score, at the place of the first; renumbered."""
    one = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "chunk_id")))


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Of repeated keys the last value, at the place of the first."""
    rest = [c for c in rows.columns if c not in (key, pos)]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("v"), F.min(pos).alias(pos))
    return one.select(key, pos, "v.*")


def assets_by_page(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """``asset_id, chunk_ids``: chunks that share a page of the same document, in order, each once."""
    c = chunks.select("doc_id", "chunk_id", F.explode("pages").alias("page"))
    a = assets.select("doc_id", "asset_id", F.explode("pages").alias("page"))
    return a.join(c, ["doc_id", "page"]).groupBy("asset_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def common_prefix(paths: Column) -> Column:
    """Longest prefix that all arrays of an array share."""
    first = F.element_at(paths, 1)
    upto = F.filter(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda n: (n <= F.size(first)) & F.forall(paths, lambda p: F.slice(p, 1, n) == F.slice(first, 1, n)))
    return F.slice(first, 1, F.coalesce(F.array_max(upto), F.lit(0)))


def context_of(hits: DataFrame) -> DataFrame:
    """Rendered evidence of each query: one numbered line a hit, by rank."""
    line = F.format_string("[%d] %s", F.col("rank"), F.col("text"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def fallback_answer(hits: DataFrame) -> DataFrame:
    """Without a language model: the first three usable texts joined, or not found."""
    best = usable_evidence(hits).where("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("answer"))
    return hits.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.col("answer").isNull(), "not_found").otherwise("answered").alias("status"))


def payload_hits(raw: DataFrame) -> DataFrame:
    """Hits of an external provider: JSON payloads with several names for a field; rank by place, score 1 / rank."""
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object("payload", f"$.{n}")), F.lit("")) for n in names])
    rank = F.coalesce(get("rank").try_cast("int"), F.lit(1))
    return raw.select(get("id", "chunk_id").alias("chunk_id"), get("content", "text", "content_with_weight").alias("text"), get("document_name", "docnm_kwd", "document_keyword").alias("document"), rank.alias("rank"), F.coalesce(get("score", "similarity").try_cast("double"), F.lit(1.0) / rank).alias("score"))
