"""Models as injected functions: what they look like, and how they run over tables in batches.

Nothing here calls a network.  A client is any object of the right shape; it is pickled to the workers, so it should
open connections when it is first called.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_BATCH, SCORE_BATCH = 50, 3


class EmbeddingClient(Protocol):
    provider: str
    model: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class CompletionClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class Scorer(Protocol):
    def __call__(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class Retriever(Protocol):
    """Hits ``(query_id, chunk_id, score, rank, retriever)`` of ``questions(query_id, text)``."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


def embedded(rows: DataFrame, key: str, client: EmbeddingClient, size: int | None = None, batch: int = EMBED_BATCH) -> DataFrame:
    """``key, embedding, provider, model`` of ``rows(key, text)``, in batches; vectors of another size are an error."""
    provider, model = client.provider, client.model

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = client.embed(list(part["text"]))
                if len(vectors) != len(part) or (size and any(len(v) != size for v in vectors)):
                    raise ValueError("a vector of the right size for each text")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors})

    out = rows.select(key, "text").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")
    return out.withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model))


def first_available(clients: Sequence[EmbeddingClient], probe: str = "probe") -> tuple[EmbeddingClient | None, list[dict]]:
    """The first client that answers a probe, and what was tried."""
    tried = []
    for client in clients:
        try:
            client.embed([probe])
        except Exception as e:  # the next one may work
            tried.append({"provider": client.provider, "model": client.model, "error": f"{type(e).__name__}: {e}"})
            continue
        tried.append({"provider": client.provider, "model": client.model, "error": None})
        return client, tried
    return None, tried


def completed(rows: DataFrame, key: str, prompt: Callable[[str], str], client: CompletionClient) -> DataFrame:
    """``key, answer, error`` of ``rows(key, text)``; a failure is an error in its row."""

    def run(batches):
        for frame in batches:
            out = []
            for k, text in zip(frame[key], frame["text"], strict=True):
                try:
                    out.append((k, client.complete(prompt(text or "")), None))
                except Exception as e:
                    out.append((k, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return rows.select(key, "text").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, answer string, error string")


def json_or(answer: str | None, default: dict) -> dict:
    """The object in a model's answer, with defaults for what isn't there."""
    text = (answer or "").strip()
    a, b = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        found = {}
    return default | (found if isinstance(found, dict) else {})


def graded(answers: DataFrame, key: str, fields: dict[str, object]) -> DataFrame:
    """JSON answers ``(key, answer)`` as text columns with safe defaults; ``fields`` are names and defaults."""
    names = list(fields)

    def run(batches):
        for frame in batches:
            rows = []
            for k, answer in zip(frame[key], frame["answer"], strict=True):
                found = json_or(answer, fields)
                rows.append((k, *(found[n] if isinstance(found[n], str) else json.dumps(found[n], ensure_ascii=False) for n in names)))
            yield pd.DataFrame(rows, columns=[key, *names])

    return answers.select(key, "answer").mapInPandas(run, f"{key} {dict(answers.dtypes)[key]}, " + ", ".join(f"{n} string" for n in names))


def generation_contexts(chunks: DataFrame, most: int = 10, chars: int = 3000, sources: int = 5) -> DataFrame:
    """Per section what a question writer is given: its first chunks joined and cut, and the ids of the first few."""
    held = chunks.groupBy("document_id", "section").agg(F.slice(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), 1, most).alias("own"))
    return held.select("document_id", "section", F.substring(F.array_join(F.transform("own", lambda x: x["text"]), "\n\n"), 1, chars).alias("text"), F.slice(F.transform("own", lambda x: x["chunk_id"]), 1, sources).alias("source_chunk_ids"))


def detected(questions: DataFrame, client: CompletionClient, allowed: Sequence[str]) -> DataFrame:
    """``query_id, entities``: a model's names that are on the list; failures name none."""
    menu = set(allowed)

    def run(batches):
        seen: dict[str, list[str]] = {}
        for frame in batches:
            rows = []
            for k, text in zip(frame["query_id"], frame["text"], strict=True):
                if text not in seen:
                    try:
                        names = json.loads(client.complete(text))
                    except Exception:
                        names = []
                    seen[text] = [n for n in dict.fromkeys(names if isinstance(names, list) else []) if n in menu]
                rows.append((k, seen[text]))
            yield pd.DataFrame(rows, columns=["query_id", "entities"])

    return questions.select("query_id", "text").mapInPandas(run, f"query_id {dict(questions.dtypes)['query_id']}, entities array<string>")


def mapped_names(names: DataFrame, client: CompletionClient, attempts: int = 3) -> DataFrame:
    """``variant, canonical, type`` of groups ``(group_id, variants)`` by a model; names it leaves out stand for themselves as ``other``."""

    def run(batches):
        for frame in batches:
            rows = []
            for variants in frame["variants"]:
                found: dict = {}
                for _ in range(attempts):
                    try:
                        found = {x["variant"]: x for x in json.loads(client.complete(json.dumps(list(variants), ensure_ascii=False)))}
                        break
                    except Exception:  # ask again
                        continue
                for v in variants:
                    one = found.get(v, {})
                    rows.append((v, one.get("canonical") or v, one.get("type") or "other"))
            yield pd.DataFrame(rows, columns=["variant", "canonical", "type"])

    return names.select("variants").mapInPandas(run, "variant string, canonical string, type string")


def scored(rows: DataFrame, metrics: dict[str, Callable[[str, str, str], float]], batch: int = SCORE_BATCH) -> DataFrame:
    """``question_id`` and a column for each metric of (question, answer, truth); a metric that fails is null."""
    names = list(metrics)

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), batch):
                out = []
                for r in frame.iloc[at : at + batch].itertuples(index=False):
                    values = []
                    for name in names:
                        try:
                            values.append(float(metrics[name](r.question, r.response, r.ground_truth)))
                        except Exception:
                            values.append(None)
                    out.append((r.question_id, *values))
                yield pd.DataFrame(out, columns=["question_id", *names])

    schema = f"question_id {dict(rows.dtypes)['question_id']}, " + ", ".join(f"{n} double" for n in names)
    return rows.select("question_id", "question", "response", "ground_truth").mapInPandas(run, schema)


class EchoModel:
    """A deterministic stand-in for tests: the first words of the prompt as triples of neighbours."""

    def complete(self, prompt: str) -> str:
        words = prompt.split()[:4]
        return json.dumps([{"subject": a, "predicate": "before", "object": b} for a, b in zip(words, words[1:], strict=False)])
