"""Knowledge graph from triples ``(triple_id, doc_id, chunk_id, subject, predicate, object)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T

FENCE, STOP_SHARE, MIN_PREDICATE, ANCHORS, RELEVANCE, BASE_WEIGHT = 2.5, 0.04, 3, 2, 6.0, 0.1
OTHER = "related_to"


def triple_id(c: Column, s: Column, p: Column, o: Column) -> Column:
    return T.short_id("stg_", F.concat_ws("|", c.cast("string"), T.graph_key(s), T.graph_key(p), T.graph_key(o)))


def staged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New triples that aren't staged yet, each once."""
    return new.dropDuplicates(["triple_id"]).join(existing.select("triple_id"), "triple_id", "left_anti")


def mentions(triples: DataFrame) -> DataFrame:
    """Per normalised surface: how often it is an endpoint, its longest spelling, its number of words."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("surface"))
    keyed = ends.select(T.graph_key(F.col("surface")).alias("key"), T.collapse(F.col("surface")).alias("surface")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("freq"), F.max(F.struct(F.length("surface"), F.col("surface"))).getField("surface").alias("name")).withColumn("words", F.size(F.split("key", " ")))


def stopwords(found: DataFrame) -> DataFrame:
    """Words in many distinct mentions that are mentions themselves and not numbers."""
    words = found.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    least = found.agg(F.greatest(F.lit(2), F.floor(F.count("*") * STOP_SHARE)).alias("least"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(least)).where("n >= least")
    alone = found.where("words = 1").select(F.col("key").alias("word"))
    return often.join(alone, "word", "left_semi").where(~F.col("word").rlike(r"^\d+$")).select("word", "n")


def canonical_predicates(triples: DataFrame) -> DataFrame:
    """Predicate -> canonical one: the most frequent with the same sorted words, rare groups become one."""
    key = F.array_join(F.array_sort(F.split(T.graph_key(F.col("predicate")), "[ _]+")), " ")
    counts = triples.groupBy("predicate").agg(F.count("*").alias("n")).withColumn("key", key)
    groups = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "predicate")).getField("predicate").alias("canonical"))
    return counts.join(groups, "key").select("predicate", F.when(F.col("total") < MIN_PREDICATE, OTHER).otherwise(F.col("canonical")).alias("canonical"))


def upper_fence(rows: DataFrame, value: str, keys: list[str], k: float = FENCE) -> DataFrame:
    """Tukey's fence with quartiles by index (s[n div 4], s[3n div 4]); null under 8 values or without spread.

    By positions from a window over counts of distinct values, so a group's values are never gathered.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keys)
    cum = counts.withColumn("upto", F.sum("c").over(own.orderBy(value))).withColumn("n", F.sum("c").over(own))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 4), F.col(value)))
    found = cum.groupBy(*keys).agg(F.first("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
    return found.withColumn("fence", F.when((F.col("n") >= 8) & (F.col("q3") > F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))))


def gated(triples: DataFrame, texts: DataFrame, generic: list[str], longest_end: int, longest_predicate: int) -> DataFrame:
    """Each triple with why it is dropped, in order of the gates, or ``ok`` with the place of its evidence."""
    key = lambda c: T.graph_key(F.col(c))
    n = lambda c: F.size(F.split(key(c), " "))
    pronoun = lambda c: key(c).isin("it", "this", "that", "they", "he", "she", "we")
    joined = triples.join(texts, "chunk_id", "left").withColumn("at", F.call_function("locate", key("evidence"), key("text")))
    reason = (
        F.when(pronoun("subject") | pronoun("object"), "pronoun_endpoint")
        .when(key("subject").isin(generic) & key("object").isin(generic), "both_generic")
        .when((n("subject") > longest_end) | (n("object") > longest_end), "clause_endpoint")
        .when(n("predicate") > longest_predicate, "clause_predicate")
        .when(F.coalesce("at", F.lit(0)) == 0, "evidence_not_found")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).drop("text")


def edges(triples: DataFrame) -> DataFrame:
    """One edge for each subject, predicate and object: weight and how many documents support it."""
    return triples.groupBy("subject", "predicate", "object").agg(F.count("*").alias("weight"), F.count_distinct("doc_id").alias("docs"))


def reach(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``seed, node, hop``: nodes within some hops, undirected, each at its nearest."""
    both = links.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(links.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    front = found
    for hop in range(1, hops + 1):
        step = front.join(both, front.node == both.a).select("seed", F.col("b").alias("node"), F.lit(hop).alias("hop")).distinct()
        front = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        found = found.unionByName(front)
    return found


def chunk_scores(reached: DataFrame, triples: DataFrame) -> DataFrame:
    """Provenance scores: each edge counts once for a seed, by its nearest end, 1 / (hop + 1) a triple."""
    near = reached.select("seed", F.col("node").alias("end"), "hop")
    touch = triples.select("triple_id", "chunk_id", F.explode(F.array_distinct(F.array("subject", "object"))).alias("end")).join(near, "end")
    once = touch.groupBy("seed", "triple_id", "chunk_id").agg(F.min("hop").alias("hop"))
    scored = once.groupBy("seed", "chunk_id").agg(F.round(F.sum(F.lit(BASE_WEIGHT) / (F.col("hop") + 1)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "chunk_id")))


def without_document(triples: DataFrame, doc_id) -> DataFrame:
    """Edges of a deleted document go even if other documents support them."""
    gone = triples.where(F.col("doc_id") == doc_id).select("subject", "predicate", "object").distinct()
    return triples.join(gone, ["subject", "predicate", "object"], "left_anti")


# ----------------------------------------------------------------------------------- entities and the clean graph

GENERIC_TYPES = ("generic", "other", "unknown", "accessory", "")


def content_key(c: Column, stop: Column) -> Column:
    """Words without stop words run together; all words where nothing else is left."""
    words = F.split(T.graph_key(c), " ")
    rest = F.filter(words, lambda w: ~F.array_contains(stop, w))
    return F.array_join(F.when(F.size(rest) > 0, rest).otherwise(words), "")


def parsed_triples(answers: DataFrame) -> DataFrame:
    """``chunk_id`` and the trimmed triples of a model's JSON list; items without subject, predicate or object go."""
    fields = ("subject", "predicate", "object", "subject_type", "object_type", "evidence")
    items = F.from_json("answer", "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    rows = answers.select("chunk_id", F.explode(items).alias("t")).select("chunk_id", *[F.trim(F.coalesce(F.col(f"t.{f}"), F.lit(""))).alias(f) for f in fields])
    return rows.where("subject <> '' AND predicate <> '' AND object <> ''")


def extracted(chunks: DataFrame, complete, gleanings: int = 1) -> DataFrame:
    """``chunk_id, answer``: an injected model's triples of each chunk as JSON, asked again until nothing new comes."""
    import json

    import pandas as pd

    def triples(text: str) -> list[dict]:
        try:
            found = json.loads(text)
        except ValueError:
            return []
        return [t for t in found if isinstance(t, dict)] if isinstance(found, list) else []

    def run(batches):
        for batch in batches:
            rows = []
            for chunk, text in zip(batch.chunk_id, batch.text, strict=True):
                held: dict[tuple, dict] = {}
                for turn in range(1 + max(0, gleanings)):
                    new = {(t.get("subject"), t.get("predicate"), t.get("object")): t for t in triples(complete(text, list(held.values())))}
                    fresh = {k: t for k, t in new.items() if k not in held}
                    held |= fresh
                    if turn and not fresh:
                        break
                rows.append((chunk, json.dumps(list(held.values()), ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["chunk_id", "answer"])

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, answer string")


def typed_mentions(triples: DataFrame) -> DataFrame:
    """``key, name, type, n``: how often each surface has each type, with the surface's longest spelling."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("surface"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("surface"), F.col("object_type").alias("type")))).alias("e")).select(T.graph_key(F.col("e.surface")).alias("key"), T.collapse(F.col("e.surface")).alias("surface"), "e.type").where("key <> ''")
    names = ends.groupBy("key").agg(F.max(F.struct(F.length("surface"), F.col("surface"))).getField("surface").alias("name"))
    return ends.groupBy("key", "type").agg(F.count("*").alias("n")).join(names, "key")


def canonical_entities(mentioned: DataFrame, clusters: DataFrame) -> DataFrame:
    """``entity_id, name, type, aliases, frequency, members``: one row a cluster of ``clusters(key, component)``.

    The id hashes the sorted members, so it stays when another spelling becomes most frequent; keys without a
    cluster stand alone.
    """
    placed = mentioned.join(clusters.select("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    keys = placed.groupBy("component", "key", "name").agg(F.sum("n").alias("freq"))
    main = keys.groupBy("component").agg(F.max(F.struct("freq", F.length("name"), "key", "name")).getField("name").alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.sum("freq").alias("frequency"), F.array_sort(F.collect_list("key")).alias("members"))
    types = placed.groupBy("component", "type").agg(F.sum("n").alias("n"))
    generic = F.col("type").isNull() | F.col("type").isin(*GENERIC_TYPES)
    kind = types.groupBy("component").agg(F.min_by("type", F.struct(generic, -F.col("n"), F.col("type"))).alias("type"))
    return main.join(kind, "component").select(T.short_id("ent_", F.array_join("members", "|")).alias("entity_id"), "name", F.coalesce("type", F.lit("")).alias("type"), "aliases", "frequency", "members")


def flipped(subject_type: Column, object_type: Column, direction: Column) -> Column:
    """Whether an edge runs against its predicate's direction ``left -> right``."""
    left, right = (F.trim(F.split(direction, "->")[k]) for k in (0, 1))
    return F.coalesce(direction.contains("->") & (subject_type == right) & (object_type == left) & (left != right), F.lit(False))


def clean_triples(kept: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """Gated triples on canonical ids: ``subject, predicate, object, flipped`` or the reason ``unresolved_entity``.

    ``entities(entity_id, type, members)``, ``predicates(predicate, canonical, direction)``; unknown predicates are the rest.
    """
    keys = entities.select("entity_id", "type", F.explode("members").alias("key"))
    side = lambda s: keys.select(F.col("key").alias(f"{s}_key"), F.col("entity_id").alias(f"{s}_id"), F.col("type").alias(f"{s}_kind"))
    named = kept.withColumns({f"{s}_key": T.graph_key(F.col(s)) for s in ("subject", "object")}).join(side("subject"), "subject_key", "left").join(side("object"), "object_key", "left").join(predicates, "predicate", "left")
    turn = flipped(F.col("subject_kind"), F.col("object_kind"), F.col("direction"))
    a, b = F.col("subject_id"), F.col("object_id")
    reason = F.when(a.isNull() | b.isNull(), "unresolved_entity").otherwise("ok")
    return named.select("triple_id", "doc_id", "chunk_id", F.when(turn, b).otherwise(a).alias("subject"), F.coalesce("canonical", F.lit(OTHER)).alias("predicate"), F.when(turn, a).otherwise(b).alias("object"), turn.alias("flipped"), reason.alias("reason"))


def evidence_edges(triples: DataFrame) -> DataFrame:
    """Edges with weight, evidence in order, and the sorted documents and chunks behind them."""
    return triples.groupBy("subject", "predicate", "object").agg(F.count("*").alias("weight"), F.transform(F.sort_array(F.collect_list(F.struct("triple_id", "evidence"))), lambda x: x["evidence"]).alias("evidence"), F.sort_array(F.collect_set("doc_id")).alias("docs"), F.sort_array(F.collect_set("chunk_id")).alias("chunks"))


def delete_document(edges_: DataFrame, nodes: DataFrame, doc_id) -> tuple[DataFrame, DataFrame]:
    """Edges without those that a document supports (others' support notwithstanding), and the nodes they still touch."""
    left = edges_.where(~F.array_contains("docs", doc_id))
    ends = left.select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct()
    return left, nodes.join(ends, "entity_id", "left_semi")


def stats(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """``nodes, edges, predicates``: totals, and how many edges each predicate has."""
    per = edges_.groupBy("predicate").agg(F.count("*").alias("n"))
    made = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "n")))).alias("predicates"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(made)


def incident(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, predicate, other, outgoing``: edges at some nodes ``(node)``, either way."""
    out = edges_.join(nodes, edges_.subject == nodes.node).select("node", "predicate", F.col("object").alias("other"), F.lit(True).alias("outgoing"))
    return out.unionByName(edges_.join(nodes, edges_.object == nodes.node).select("node", "predicate", F.col("subject").alias("other"), F.lit(False).alias("outgoing")))


def found_nodes(entities: DataFrame, names: DataFrame) -> DataFrame:
    """``asked, entity_id``: entities by name or alias, whatever the case; the first by id."""
    keyed = entities.select("entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("surface")).select("entity_id", T.graph_key(F.col("surface")).alias("key"))
    return names.withColumn("key", T.graph_key(F.col("asked"))).join(keyed, "key").groupBy("asked").agg(F.min("entity_id").alias("entity_id"))


def relation_type(predicate: Column) -> Column:
    """A predicate as a relation type: capitals, digits and underscores."""
    name = F.regexp_replace(F.regexp_replace(F.upper(T.fold(predicate)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "RELATED_TO").otherwise(name)


def node_link(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Rows of a node-link export: ``kind`` node or link, and the record as JSON."""
    links = edges_.withColumn("type", relation_type(F.col("predicate")))
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("record")).unionByName(links.select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("record")))


def latest_texts(staged_rows: DataFrame) -> DataFrame:
    """The newest text of each chunk."""
    return staged_rows.groupBy("chunk_id").agg(F.max_by("text", "extracted_at").alias("text"))


def not_extracted(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose text hasn't been extracted: by id and the first 16 digits of its hash."""
    return chunks.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16)).join(done.select("chunk_id", "content_hash").distinct(), ["chunk_id", "content_hash"], "left_anti")


def usable_chunks(chunks: DataFrame, dropped=("exact_sha256",), most: int | None = None) -> DataFrame:
    """Chunks for the graph: no duplicates of a dropped layer; of the first documents by key if a number is given."""
    layers = F.coalesce(F.col("layers"), F.array().cast("array<string>"))
    left = chunks.where(~(F.coalesce("has_duplicate", F.lit(False)) & F.arrays_overlap(layers, F.array(*map(F.lit, dropped)))))
    if most is None:
        return left
    first = left.select("document_id").distinct().orderBy("document_id").limit(most)
    return left.join(first, "document_id", "left_semi")


def built(triples: DataFrame, texts: DataFrame, clusters: DataFrame, directions: DataFrame, generic: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole build: entities, edges, and dropped triples with their reasons."""
    ends = triples.select(F.size(F.split(T.graph_key(F.col("subject")), " ")).alias("n")).unionByName(triples.select(F.size(F.split(T.graph_key(F.col("object")), " ")).alias("n")))
    bound = lambda rows: (upper_fence(rows.withColumn("g", F.lit(1)), "n", ["g"]).first() or {"fence": None})["fence"]
    most = [int(x) if x is not None else 1 << 30 for x in (bound(ends), bound(triples.select(F.size(F.split(T.graph_key(F.col("predicate")), " ")).alias("n"))))]
    judged = gated(triples, texts, generic, *most)
    entities = canonical_entities(typed_mentions(triples), clusters)
    registry = canonical_predicates(triples).join(directions, "canonical", "left")
    clean = clean_triples(judged.where("reason = 'ok'"), entities, registry)
    dropped = judged.where("reason <> 'ok'").select("triple_id", "reason").unionByName(clean.where("reason <> 'ok'").select("triple_id", "reason"))
    good = clean.where("reason = 'ok'").join(triples.select("triple_id", "evidence"), "triple_id")
    return entities, evidence_edges(good), dropped
