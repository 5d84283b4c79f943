"""Workbooks (XLSX) and tab-separated sheets as DataFrames, with the standard library on Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
ROWS = "path string, sheet int, row int, cells map<int,string>"
CELL_LIMIT = 32_767  # characters that a cell may hold


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def rows_of(content: bytes) -> Iterator[tuple[int, int, dict[int, str]]]:
    """Sheet (from 1), row number and cells by column number; cells are text as written."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        for sheet in sorted(int(m[1]) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))):
            for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{_NS['m']}}}row"):
                cells = {}
                for c in row.findall("m:c", _NS):
                    kind, value = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else value.text
                    cells[_column(c.get("r"))] = text
                yield sheet, int(row.get("r")), cells


def workbook(rows: list[list[object]]) -> bytes:
    """One sheet of rows; numbers as numbers, all else as text, cut to what a cell may hold."""

    def cell(r: int, k: int, v: object) -> str:
        at = f"{_letters(k)}{r}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return "" if v is None else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))[:CELL_LIMIT])}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, k, v) for k, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
    out, head = io.BytesIO(), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    types = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{types}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def parsed(files: DataFrame) -> DataFrame:
    """``path, sheet, row, cells`` from ``files(path, content)``."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(p, *row) for p, content in zip(batch.path, batch.content, strict=True) for row in rows_of(content)], columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path))


def named(rows: DataFrame, header: dict[int, str], first: int) -> DataFrame:
    """Cells as columns, by the header's column numbers, from a row on."""
    return rows.where(F.col("row") >= first).select("path", "row", *[F.col("cells")[k].alias(name) for k, name in header.items()])


def header_of(rows: DataFrame, row: int) -> dict[int, str]:
    """Column names of a header row (one row goes to the driver)."""
    found = rows.where(F.col("row") == row).select("cells").first()
    return {k: re.sub(r"\W+", "_", v.strip().lower()) for k, v in sorted((found.cells if found else {}).items()) if v and v.strip()}


def review_rows(rows: DataFrame, question: str = "question", answer: str = "bot_response", status: str = "review_status") -> DataFrame:
    """Review rows with a question; those answered are ``evaluated``, others keep their status or are ``pending``."""
    shown = F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", "evaluated").otherwise(F.coalesce(F.nullif(F.trim(F.col(status)), F.lit("")), F.lit("pending")))
    return rows.where(F.trim(F.coalesce(question, F.lit(""))) != "").withColumn("display_status", shown)


def imported(rows: DataFrame, known: DataFrame, approved: Column) -> DataFrame:
    """New (question, ground_truth) pairs, each once (the first row), with whether they are approved or drafts."""
    full = rows.where("trim(coalesce(question, '')) <> '' AND trim(coalesce(ground_truth, '')) <> ''").withColumn("approved", F.coalesce(approved, F.lit(False)))
    rest = [c for c in full.columns if c not in ("question", "ground_truth")]
    first = full.groupBy("question", "ground_truth").agg(F.min_by(F.struct(*rest), "row").alias("r")).select("question", "ground_truth", "r.*")
    return first.join(known.select("question", "ground_truth").distinct(), ["question", "ground_truth"], "left_anti")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sheets saved as tab-separated text, cells with line breaks in quotes."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
