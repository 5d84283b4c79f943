"""The answering flow over many questions at once: route, retrieve, rerank, rewrite, generate.

State is a table with a row a question: ``query_id, text, step, status, tried, rejected``.  Each step is a table in, table
out; the loop runs on the driver for at most ``MAX_STEPS`` rounds and looks at counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import rules as R
from quarrylake.functions import text as T
from quarrylake.operators import records, retrieval
from quarrylake.operators.cluster import written

MAX_STEPS, LEAST_EVIDENCE, CONTEXT_LEAST = 3, 2, 12
#: Ids of chunks that are sent to all executors.
SENT_IDS = 500_000


@dataclass(frozen=True)
class Config:
    """All knobs of a run; a copy with changes is made for each, nothing is global."""

    top_k: int = 5
    candidates: int = 20
    fusion: str = "rrf"
    min_fused: float | None = None
    entity_filter: bool = False
    boost: bool = True
    max_steps: int = MAX_STEPS

    def with_(self, **changes) -> Config:
        known = {k: v for k, v in changes.items() if v is not None}
        return replace(self, **known)

    def snapshot(self) -> Column:
        """The effective knobs as one JSON text."""
        return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(asdict(self).items())]), {"ignoreNullFields": "false"})


def started(questions: DataFrame, replying: Column | None = None) -> DataFrame:
    """State of ``questions(query_id, text)``: small talk and unclear questions end here."""
    why = R.clarification(F.col("text"), F.lit(False) if replying is None else replying)
    chat = R.small_talk(F.col("text"))
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "not_found").when(chat.isNotNull(), "answered").when(why != "", "clarification_needed").otherwise("open")
    return questions.select("query_id", "text", F.lit(0).alias("step"), status.alias("status"), F.when(status == "clarification_needed", why).when(status == "answered", chat).alias("reason"), F.array("text").alias("tried"), F.array().cast("array<long>").alias("rejected"))


def after_clarification(status: Column) -> Column:
    return F.when(status == "open", "retrieve").otherwise("end")


def after_rerank(step: Column, missing: Column, best: Column, least: float, most: int = MAX_STEPS) -> Column:
    """Step cap first, then missing entities, then the best score."""
    return F.when(step >= most, "generate").when(missing | F.coalesce(best < least, F.lit(True)), "transform").otherwise("generate")


def after_transform(fresh: Column) -> Column:
    return F.when(fresh > 0, "retrieve").otherwise("generate")


def after_check(grounded: Column, step: Column, most: int = MAX_STEPS) -> Column:
    return F.when(grounded | (step >= most), "end").otherwise("transform")


def without_rejected(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Hits without what was rejected before; a query whose hits would all go keeps them."""
    known = hits.join(state.select("query_id", "rejected"), "query_id", "left")
    bad = F.coalesce(F.array_contains("rejected", F.col("chunk_id")), F.lit(False))
    left = F.count_if(~bad).over(Window.partitionBy("query_id"))
    return known.withColumn("_left", left).where(~bad | (F.col("_left") == 0)).drop("rejected", "_left")


def reranked(hits: DataFrame, state: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The kept hits, and per query ``kept, missing, best, rejected`` (what fell below the least score)."""
    best = retrieval.rerank_by_score(without_rejected(hits, state), k)
    judged = best.withColumn("good", F.col("score") >= least)
    told = judged.groupBy("query_id").agg(F.count_if("good").alias("kept"), F.max("score").alias("best"), F.array_sort(F.collect_set(F.when(~F.col("good"), F.col("chunk_id")))).alias("bad"))
    return judged.where("good").drop("good"), told.withColumn("missing", F.col("kept") < LEAST_EVIDENCE)


def transformed(state: DataFrame, rewrites: DataFrame) -> DataFrame:
    """State with the fresh ones of ``rewrites(query_id, texts)``: what was tried is left out; without any, ``exhausted``."""
    joined = state.join(rewrites, "query_id", "left")
    fresh = F.array_except(F.coalesce("texts", F.array().cast("array<string>")), F.col("tried"))
    return joined.withColumn("fresh", fresh).withColumn("status", F.when((F.col("status") == "open") & (F.size("fresh") == 0), "exhausted").otherwise(F.col("status"))).withColumn("tried", F.array_union("tried", "fresh")).withColumn("text", F.coalesce(F.try_element_at("fresh", F.lit(1)), F.col("text"))).drop("texts", "fresh")


def merged_documents(pinned: DataFrame, relevant: DataFrame) -> DataFrame:
    """Pinned and relevant hits, each chunk once with its best score, best first."""
    both = pinned.select("query_id", "chunk_id", "score").unionByName(relevant.select("query_id", "chunk_id", "score"))
    one = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return retrieval.ranked(one, None, F.desc("score"), F.col("chunk_id"))


def resolved_evidence(questions: DataFrame, explicit: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Evidence by question: given chunks before retrieved ones, and which it was; none without either."""
    given = explicit.select("query_id").distinct().withColumn("given", F.lit(True))
    rest = retrieved.join(given, "query_id", "left_anti")
    both = explicit.withColumn("origin", F.lit("explicit")).unionByName(rest.withColumn("origin", F.lit("retrieved")))
    return questions.select("query_id").join(both, "query_id", "left").withColumn("origin", F.coalesce("origin", F.lit("none")))


def generated(questions: DataFrame, evidence: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``query_id, answer, status, citations``: a model's ``answers(query_id, answer)``, or the first three evidence texts.

    Blank questions, no usable evidence or a context that says nothing: not found.  Answers are checked: citations
    out of range or a not-found phrase make them not found.
    """
    usable = records.usable_evidence(evidence)
    held = usable.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("own"))
    texts = F.transform(F.slice("own", 1, 3), lambda x: F.trim(x["text"]))
    rows = questions.select("query_id", "text").join(held, "query_id", "left")
    said = F.lit(None).cast("string") if answers is None else F.col("said")
    if answers is not None:
        rows = rows.join(answers.select("query_id", F.col("answer").alias("said")), "query_id", "left")
    ready = (F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("own").isNotNull() & (F.length(F.array_join(texts, "\n")) >= CONTEXT_LEAST)
    payload = records.json_object(said)
    spoken = F.coalesce(F.get_json_object(payload, "$.answer"), said, F.array_join(texts, "\n\n"))
    answer = R.without_reference_list(spoken)
    picked = R.selected_citations(answer, R.declared_citations(payload), F.size("own"))
    good = ready & ~R.is_not_found(answer) & (F.size(picked["numbers"]) > 0)
    cited = F.transform(picked["numbers"], lambda n: F.element_at("own", n)["chunk_id"])
    return rows.select("query_id", F.when(good, R.renumbered(answer)).alias("answer"), F.when(good, "answered").otherwise("not_found").alias("status"), F.when(good, cited).alias("citations"))


def texts_of(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``chunk_id, text`` of chunks that some question has: the others go where they are read, unless the hits are too many to send."""
    ids = hits.select("chunk_id").distinct()
    sent = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    return written(texts.select("chunk_id", "text").join(sent, "chunk_id", "left_semi"), "texts")


def answered(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], texts: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None, config: Config | None = None, least: float = 0.0) -> DataFrame:
    """Run the flow: ``query_id, answer, status, citations, steps`` for each question.

    ``retrieve`` gives hits of ``(query_id, text)``; ``rewrite`` gives ``(query_id, texts)`` for questions that found too little.
    """
    config = config or Config()
    state = written(started(questions), "state")
    kept = None
    for step in range(config.max_steps):
        open_ = state.where("status = 'open'")
        if open_.isEmpty():
            break
        found = written(retrieve(open_.select("query_id", "text")).select("query_id", "chunk_id", "score", "rank", "retriever"), "found")
        hits, told = reranked(found, open_, config.top_k, least)
        told = written(told, "told")
        hits = written(hits.select("query_id", "chunk_id", "score"), "kept")
        kept = hits if kept is None else kept.unionByName(hits)
        after = open_.drop("rejected").join(open_.select("query_id", "rejected"), "query_id").join(told.select("query_id", "kept", "missing", "best", "bad"), "query_id", "left")
        way = after_rerank(F.lit(step + 1), F.coalesce("missing", F.lit(True)), F.col("best"), least, config.max_steps)
        moved = after.withColumn("status", F.when(way == "generate", "done").otherwise("open")).withColumn("step", F.lit(step + 1)).withColumn("rejected", F.array_union("rejected", F.coalesce("bad", F.array().cast("array<long>")))).select(*state.columns)
        rewrites = moved.select("query_id", F.array().cast("array<string>").alias("texts")) if rewrite is None else rewrite(moved.where("status = 'open'").select("query_id", "text"))
        state = written(state.where("status <> 'open'").unionByName(transformed(moved, rewrites)), "state")
    pool = kept if kept is not None else state.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    found = merged_documents(pool, pool.limit(0)).join(texts_of(pool, texts), "chunk_id")
    flow = state.where(F.col("status").isin("done", "exhausted", "open"))
    out = generated(questions.join(flow.select("query_id"), "query_id", "left_semi"), found)
    rest = state.where(~F.col("status").isin("done", "exhausted", "open")).select("query_id", F.lit(None).cast("string").alias("answer"), "status", F.lit(None).cast("array<long>").alias("citations"))
    return out.unionByName(rest).join(state.select("query_id", F.col("step").alias("steps")), "query_id")


def traces(questions: DataFrame, hits: DataFrame, answers: DataFrame, run_id: str, config: Config) -> DataFrame:
    """One JSON record a question of what was found and said, for an append-only file."""
    own = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("score", 6).alias("score")))).alias("evidence"))
    joined = questions.select("query_id", "text").join(own, "query_id", "left").join(answers.select("query_id", "answer", "status"), "query_id", "left")
    return joined.select("query_id", F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.col("text").alias("question"), "evidence", "answer", "status", config.snapshot().alias("config"))).alias("trace"))


def ingested(pages: DataFrame, existing: DataFrame, chunker: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Pages through parsing, chunking, duplicate detection against what is there, and quality: all tables that are then written.

    ``parse`` gives ``(doc_id, text)``, ``chunker`` gives ``(doc_id, idx, chunk)``; ``existing(chunk_id, pos, text)``.
    """
    from quarrylake.operators import dedup, quality

    parts = chunker(parse(pages))
    chunks = written(parts.select((F.col("doc_id") * 1_000_000 + F.col("idx")).alias("chunk_id"), "doc_id", F.col("idx").alias("chunk_index"), (F.col("doc_id") * 1_000_000 + F.col("idx")).alias("pos"), F.col("chunk").alias("text"), T.fingerprint(F.col("chunk")).alias("content_hash")), "chunks")
    matches = dedup.incremental(existing, chunks.select("chunk_id", "pos", "text"))
    return {"chunks": dedup.attached(chunks, matches), "matches": matches, "groups": quality.exact_groups(chunks)}
