"""Text to chunks: sections by headings, paragraphs packed to a budget, character windows.

Where the next cut depends on the last one there is no built-in expression; whole batches go through Arrow.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators.cluster import by_slices

MAX_CHARS, OVERLAP, MIN_CHARS, MAX_TOKENS = 2048, 0, 40, 512
#: Blocks shorter than this are joined with neighbours under one heading.
SHORT = 512
#: Lines that begin a part of a section: numbered, bold, or all capitals.
_NUMBERED = re.compile(r"^\s*(?:-\s*)?(\d+(?:\.\d+)*?)[.)]\s+(.{3,120})$")
_BOLD = re.compile(r"^\s*(?:-\s*)?\*\*(.{2,80}?)\*\*:?\s*$")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$", re.MULTILINE)


def sections_of(markdown: str) -> list[tuple[str, int, list[str], str, int, int]]:
    """Title, level, path, body and its place for each heading with a body (and the text before the first)."""
    heads = [(m.start(), m.end(), len(m[1]), m[2].strip()) for m in _HEADING.finditer(markdown)]
    bounds = [(0, 0, 0, "")] * (not heads or heads[0][0] > 0) + heads
    path: list[tuple[int, str]] = []
    out = []
    for k, (_, end, level, title) in enumerate(bounds):
        stop = bounds[k + 1][0] if k + 1 < len(bounds) else len(markdown)
        if title:
            path = [p for p in path if p[0] < level] + [(level, title)]
        body = markdown[end:stop]
        text = body.strip()
        if text:
            start = end + len(body) - len(body.lstrip())
            out.append((title, level, [t for _, t in path], text, start, start + len(text)))
    return out


def windows_of(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Places of windows of at most size characters that end at a space where there is one in the second half."""
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            space = max(text.rfind(" ", start + size // 2, stop), text.rfind("\n", start + size // 2, stop))
            stop = space if space > start else stop
        out.append((start, stop))
        if stop >= len(text):
            break
        start = max(stop - overlap, start + 1)
        while start < len(text) and text[start].isspace():
            start += 1
    return [(a, b) for a, b in out if text[a:b].strip()]


def packed_of(text: str, max_chars: int = MAX_CHARS) -> list[str]:
    """Paragraphs packed up to a budget; a paragraph beyond it is cut into windows."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n|\n", text)):
        if not part:
            continue
        if len(part) > max_chars:
            out += [held] * bool(held) + [part[a:b].strip() for a, b in windows_of(part, max_chars)]
            held = ""
        elif held and len(held) + 2 + len(part) > max_chars:
            out.append(held)
            held = part
        else:
            held = f"{held}\n\n{part}" if held else part
    return out + [held] * bool(held)


def section_parts_of(markdown: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[str, int, str]]:
    """Section-aware chunks (title, part, text): paragraphs packed to a budget, an oversized one in fixed windows."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the budget")
    out = []
    for title, _, _, body, _, _ in sections_of(markdown):
        held, parts = "", []
        if len(body) <= max_chars:
            parts = [body]
        else:
            for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", body))):
                joined = f"{held}\n\n{paragraph}" if held else paragraph
                if len(joined) <= max_chars:
                    held = joined
                    continue
                parts += [held] * bool(held)
                held = ""
                if len(paragraph) <= max_chars:
                    parts.append(paragraph)
                else:
                    at = range(0, max(1, len(paragraph) - overlap), max_chars - overlap)
                    parts += [x for a in at if (x := paragraph[a : a + max_chars].strip())]
            parts += [held] * bool(held)
        out += [(title, k, text) for k, text in enumerate(parts)]
    return out


def _part_title(line: str) -> str | None:
    line = line.strip()
    if m := _NUMBERED.match(line):
        return f"{m[1]} {m[2]}".strip()
    if m := _BOLD.match(line):
        return m[1].strip()
    if line and len(line) <= 60 and line[0] not in "#|-" and line.isupper() and sum(c.isalpha() for c in line) >= 3:
        return line
    return None


def _blocks_of(markdown: str, root: str | None) -> list[tuple[list[str], int, int, int]]:
    """Path, level and place of each part of each section that has a text."""
    out = []
    for _, level, path, body, start, _ in sections_of(markdown):
        if root and (not path or path[0].strip().lower() != root.strip().lower()):
            path = [root.strip(), *path]
        marks, at = [], 0
        for line in body.splitlines(keepends=True):
            if title := _part_title(line):
                marks.append((at, at + len(line), title))
            at += len(line)
        bounds = [(0, 0, None), *marks] if not marks or body[: marks[0][0]].strip() else marks
        if len(bounds) <= 1:
            bounds = [(0, 0, None)]
        for k, (_, a, title) in enumerate(bounds):
            b = bounds[k + 1][0] if k + 1 < len(bounds) else len(body)
            text = body[a:b].strip()
            if text:
                first = start + a + len(body[a:b]) - len(body[a:b].lstrip())
                out.append((path + [title] * bool(title), level, first, first + len(text)))
    return out


def _shared(paths: list[list[str]]) -> list[str]:
    out = []
    for names in zip(*paths, strict=False):
        if len(set(names)) > 1:
            break
        out.append(names[0])
    return out


def _merged(blocks, key, fits, limit: int):
    """Runs of neighbours with one key joined while they fit a budget together."""
    out, run = [], []

    def flush():
        if run:
            out.append((_shared([b[0] for b in run]), run[0][1], run[0][2], run[-1][3]) if len(run) > 1 else run[0])
            run.clear()

    for block in blocks:
        if not fits(block):
            flush()
            out.append(block)
            continue
        if run and (key(run[0]) != key(block) or block[3] - run[0][2] > limit):
            flush()
        run.append(block)
    flush()
    return out


def _sliced(body: str, max_chars: int) -> list[str]:
    """Lines and paragraphs packed to a budget; a longer line by sentences, a longer sentence by characters."""
    units = []
    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", body))):
        for line in [block] if len(block) <= max_chars else filter(None, map(str.strip, block.splitlines())):
            for sentence in [line] if len(line) <= max_chars else re.split(r"(?<=[.!?;])\s+", line):
                units += [sentence[a : a + max_chars] for a in range(0, len(sentence), max_chars)]
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) + 1 + len(unit) <= max_chars:
            out[-1] += "\n" + unit
        else:
            out.append(unit)
    return out


def hierarchical_of(markdown: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, root: str | None = None) -> list[tuple[list[str], int, int, int, int, int, str]]:
    """Path, level, part, parts, place and text of hierarchical chunks.

    Short blocks with one parent are joined, then neighbours under the same two top headings, while they fit;
    longer ones are cut, each later part beginning with the last ``overlap`` characters (from a word on) of the one
    before.  Single parts of under ``MIN_CHARS`` characters without a digit go.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the budget")
    blocks = _merged(_blocks_of(markdown, root), lambda b: b[0][:-1], lambda b: len(b[0]) >= 2 and b[3] - b[2] < SHORT, max_chars)
    blocks = _merged(blocks, lambda b: b[0][:2], lambda b: b[3] - b[2] <= max_chars, max_chars)
    out = []
    for path, level, start, end in blocks:
        body = markdown[start:end]
        parts = [body] if len(body) <= max_chars else _sliced(body, max_chars)
        if len(parts) == 1 and len(body.strip()) < MIN_CHARS and not any(c.isdigit() for c in body):
            continue
        at = 0
        for k, part in enumerate(parts):
            probe = part.split("\n", 1)[0]
            at = max(at, body.find(probe, at))
            tail = parts[k - 1][-overlap:] if k and overlap else ""
            tail = tail.split(" ", 1)[-1] if " " in tail else tail
            out.append((path, level, k + 1, len(parts), start + at, min(end, start + at + len(part)), f"{tail}\n{part}".strip()))
            at += len(probe)
    return out


def boundary_of(text: str, size: int = 1500, seek: int = 200, overlap: int = 200) -> list[str]:
    """Windows over collapsed text that end after a period in their last ``seek`` characters, else at the last space."""
    text = " ".join(text.split())
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            period = text.rfind(". ", max(start, stop - seek), stop)
            space = text.rfind(" ", start, stop)
            stop = period + 1 if period >= 0 else space if space > start else stop
        out.append(text[start:stop].strip())
        if stop >= len(text):
            break
        start = max(stop - overlap, start + 1)
    return [x for x in out if x]


def _exploded(frame: DataFrame, make, schema: str) -> DataFrame:
    def rows_of(ids, texts):
        return ((i, k, *row) for i, text in zip(ids, texts, strict=True) for k, row in enumerate(make(text or "")))

    return by_slices(frame.select("doc_id", "text"), rows_of, schema)


def sections(docs: DataFrame) -> DataFrame:
    return _exploded(docs, sections_of, "doc_id long, idx long, title string, level int, path array<string>, body string, start int, stop int")


def windows(docs: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    return _exploded(docs, lambda t: [(t[a:b], a, b) for a, b in windows_of(t, size, overlap)], "doc_id long, idx long, chunk string, start int, stop int")


def packed(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    return _exploded(docs, lambda t: [(p,) for p in packed_of(t, max_chars)], "doc_id long, idx long, chunk string")


def paragraphs(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Paragraphs (lines) with their place, by built-in functions; shorter ones without a digit go."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "raw")).withColumn("chunk", T.collapse(F.col("raw")))
    return lines.where((F.length("chunk") >= least) | F.col("chunk").rlike(r"\d")).where("chunk <> ''").select("doc_id", "idx", "chunk", F.size(F.split("chunk", " ")).alias("tokens"))


def token_groups(parts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Group consecutive paragraphs by which multiple of the budget their first word falls in."""
    from pyspark.sql import Window

    own = Window.partitionBy("doc_id").orderBy("idx")
    start = F.sum("tokens").over(own) - F.col("tokens")
    grouped = parts.withColumn("part", F.floor(start / max_tokens))
    return grouped.groupBy("doc_id", "part").agg(F.count("*").alias("paragraphs"), F.sum("tokens").alias("tokens"), F.min("idx").alias("first_idx"))


def section_parts(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    return _exploded(docs, lambda t: section_parts_of(t, max_chars, overlap), "doc_id long, idx long, title string, part int, chunk string")


def hierarchical(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, root: str | None = None) -> DataFrame:
    return _exploded(docs, lambda t: hierarchical_of(t, max_chars, overlap, root), "doc_id long, idx long, path array<string>, level int, part int, parts int, start int, stop int, chunk string")


def boundaries(docs: DataFrame, size: int = 1500, seek: int = 200, overlap: int = 200) -> DataFrame:
    return _exploded(docs, lambda t: [(x,) for x in boundary_of(t, size, seek, overlap)], "doc_id long, idx long, chunk string")


def by_pages(items: DataFrame) -> DataFrame:
    """Page-aware chunks of ``items(doc_id, idx, pages, text)``: texts of the same pages joined, in order."""
    held = items.where("trim(text) <> ''").groupBy("doc_id", "pages").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("own"))
    return held.select("doc_id", "pages", F.col("own")[0]["idx"].alias("idx"), F.array_join(F.transform("own", lambda x: F.trim(x["text"])), "\n\n").alias("chunk"))


CHUNKERS = {"windows": windows, "packed": packed, "sections": section_parts, "hierarchical": hierarchical, "boundaries": boundaries}


def chunked(docs: DataFrame, name: str, **how) -> DataFrame:
    """A chunker by name; where it can't be loaded (models, say) the hierarchical one stands in."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name}; known: {', '.join(sorted(CHUNKERS))}")
    try:
        return CHUNKERS[name](docs, **how)
    except (ImportError, OSError):
        return hierarchical(docs)


def built(parts: DataFrame, kind: str) -> DataFrame:
    """Chunk records of ``parts(source, section, idx, chunk)``: id, number within the section, hash of the content."""
    from pyspark.sql import Window

    section = F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("main"))
    numbered = parts.withColumn("section", section).withColumn("chunk_index", F.row_number().over(Window.partitionBy("source", "section").orderBy("idx")) - 1)
    return numbered.select(T.chunk_id(F.lit(kind), F.col("source"), F.col("section"), F.col("chunk_index")).alias("chunk_id"), "source", "section", "chunk_index", F.col("chunk").alias("text"), T.fingerprint(F.col("chunk")).alias("content_hash"))


def from_text(docs: DataFrame, kind: str = "text") -> DataFrame:
    """Plain texts ``(doc_id, text)`` to chunk records: white space collapsed, windows of the budget; empty texts have none."""
    clean = docs.select("doc_id", T.collapse(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    return built(windows(clean).select(F.col("doc_id").cast("string").alias("source"), F.lit("").alias("section"), "idx", "chunk"), kind)
