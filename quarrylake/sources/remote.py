"""Sources beyond files: pages by URL, remote chunk lists, documents parsed by a library; clients are injected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib import parse, request

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "url string, status int, charset string, html string, error string"
TIMEOUT = 20


def http_fetch(url: str) -> tuple[int, str, bytes]:
    """Status, charset and body of a page; only http and https."""
    if parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError("only http and https")
    with request.urlopen(request.Request(url, headers={"User-Agent": "quarrylake"}), timeout=TIMEOUT) as got:  # noqa: S310
        return got.status, got.headers.get_content_charset() or "utf-8", got.read()


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str, bytes]] = http_fetch) -> DataFrame:
    """Pages of ``urls(url)``: text by their charset, bytes that don't fit replaced; failures as errors in their row."""

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.url:
                try:
                    status, charset, body = fetch(url)
                    rows.append((url, status, charset, body.decode(charset, "replace"), None))
                except Exception as e:  # one page must not stop the others
                    rows.append((url, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    return urls.select("url").mapInPandas(run, PAGES)


def documents_to_markdown(files: DataFrame, parsers: dict[str, Callable[[bytes], str]], pipeline: str) -> DataFrame:
    """``path, markdown, error`` of ``files(path, content)`` by a named parser (a seam: none is built in)."""
    if pipeline not in parsers:
        raise ValueError(f"unknown parser {pipeline}; known: {', '.join(sorted(parsers)) or 'none'}")
    parser = parsers[pipeline]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows.append((path, parser(bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


ELEMENTS = "path string, element_id string, kind string, pages array<int>, caption string"


def document_elements(files: DataFrame, find: Callable[[bytes], Iterator[tuple[str, list[int], str]]]) -> DataFrame:
    """One row for each picture, table and chart that an injected parser finds, numbered in order."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(p, f"{kind}-{n:03d}", kind, pages, caption) for p, content in zip(batch.path, batch.content, strict=True) for n, (kind, pages, caption) in enumerate(find(bytes(content)), 1)], columns=["path", "element_id", "kind", "pages", "caption"])

    return files.select("path", "content").mapInPandas(run, ELEMENTS)


def has_heading(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?m)^#{1,6}\s+\S"), F.lit(False))


def best_markdown(walked: Column, extracted: Column, sections: Column) -> Column:
    """``struct<markdown, extractor>``: the walker's Markdown if it has a heading, else the extractor's, else the sections'."""
    known = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    pick = lambda c, name: F.struct(c.alias("markdown"), F.lit(name).alias("extractor"))
    return F.when(has_heading(walked), pick(walked, "dom")).when(known(extracted), pick(extracted, "extractor")).otherwise(pick(F.coalesce(sections, F.lit("")), "sections"))


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _get(self, page: int) -> dict:
        query = {k: self.options[k] for k in ("dataset", "document", "keywords") if k in self.options}
        url = f"{self.options['url']}?{parse.urlencode(query | {'page': page, 'page_size': self.options.get('page_size', '100')})}"
        asked = request.Request(url, headers={"Authorization": f"Bearer {self.options['token']}"} if "token" in self.options else {})
        with request.urlopen(asked, timeout=TIMEOUT) as got:  # noqa: S310
            return json.load(got)

    def partitions(self):
        total = int(self._get(1).get("total", 0))
        return [_Page(n + 1) for n in range(-(-total // int(self.options.get("page_size", "100"))))]

    def read(self, partition: _Page):
        for item in self._get(partition.number).get("chunks", []):
            if isinstance(item, dict):
                yield (json.dumps(item),)


class RemoteChunks(DataSource):
    """``spark.read.format("remote_chunks")``: payloads of a paged JSON endpoint, a task for each page."""

    @classmethod
    def name(cls) -> str:
        return "remote_chunks"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(dict(self.options))


def remote_chunks(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """``payload`` of each remote chunk; :func:`quarrylake.operators.records.payload_hits` reads them."""
    spark.dataSource.register(RemoteChunks)
    return spark.read.format("remote_chunks").option("url", url).options(**options).load()
