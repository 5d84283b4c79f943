"""HTML pages to text, sections, metadata and assets, with the standard library's parser on Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.cluster import by_slices

IGNORED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "template"}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "section", "article", "main", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
SCHEMA = "page_id long, title string, lang string, canonical string, n_sections int, headings array<string>, n_links int, n_images int, text string, markdown string, meta map<string,string>, assets array<struct<kind:string,source:string>>"


#: Elements whose end may be missing: main text ends them.
LOOSE = {"nav", "footer", "header", "aside"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class PageParser(HTMLParser):
    """Text outside of ignored elements, plain and as Markdown; h1 to h3 begin sections."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.canonical = "", None, None
        self.meta: dict[str, str] = {}
        self.assets: list[tuple[str, str]] = []
        self.lines: list[tuple[int, str, str]] = []
        self.headings: list[str] = []
        self.links = self.images = 0
        self._skip: list[str] = []
        self._plain: list[str] = []
        self._marked: list[str] = []
        self._lists: list[list] = []
        self._prefix = ""
        self._hrefs: list[tuple[str | None, int]] = []
        self._row: list[str] | None = None
        self._rows = 0
        self._level, self._in_title = 0, False

    def _add(self, plain: str, marked: str | None = None) -> None:
        self._plain.append(plain)
        self._marked.append(plain if marked is None else marked)

    def _flush(self) -> None:
        line, marked = (" ".join("".join(x).split()) for x in (self._plain, self._marked))
        if line:
            self.lines.append((self._level, line, line if self._level else self._prefix + marked))
            if self._level:
                self.headings.append(line)
            self._prefix = ""
        self._plain, self._marked = [], []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "html":
            self.lang = values.get("lang")
        elif tag == "link" and (values.get("rel") or "") == "canonical":
            self.canonical = values.get("href")
        elif tag == "meta" and (name := (values.get("property") or values.get("name") or "").lower()):
            self.meta.setdefault(name, values.get("content") or "")
        elif tag == "title":
            self._in_title = True
        if self._skip and tag in ("main", "article") and set(self._skip) <= LOOSE:
            self._skip.clear()
        if tag in IGNORED:
            self._flush()
            self._skip.append(tag)
        if self._skip:
            return
        self.links += tag == "a"
        self.images += tag == "img"
        if tag in ("img", "iframe", "object") and (source := values.get("src") or values.get("data")):
            self.assets.append((tag, source))
        if tag in ("tr", "table"):
            self._end_row()
        if self._row is not None and tag in BLOCKS:
            self._add(" ")
        elif tag in BLOCKS:
            self._flush()
        if tag in ("h1", "h2", "h3"):
            self._level = int(tag[1])
        elif tag in ("ul", "ol"):
            self._lists.append([tag, 0])
        elif tag == "li":
            self._lists = self._lists or [["ul", 0]]
            self._lists[-1][1] += 1
            self._prefix = "  " * (len(self._lists) - 1) + ("- " if self._lists[-1][0] == "ul" else f"{self._lists[-1][1]}. ")
        elif tag == "table":
            self._rows = 0
        elif tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._end_cell()
        elif tag in MARKS:
            self._add("", MARKS[tag])
        elif tag == "a":
            self._hrefs.append((values.get("href"), len(self._marked)))
            if (values.get("href") or "").lower().split("?")[0].endswith(".pdf"):
                self.assets.append(("pdf", values["href"]))

    def _end_cell(self) -> None:
        text = " ".join("".join(self._plain).split())
        self._plain, self._marked = [], []
        if text and self._row is not None:
            self._row.append(text.replace("|", "/"))

    def _end_row(self) -> None:
        if self._row is None:
            return
        self._end_cell()
        if self._row:
            self.lines.append((0, " ".join(self._row), "| " + " | ".join(self._row) + " |"))
            if not self._rows:
                self.lines.append((0, "", "| " + " | ".join("---" for _ in self._row) + " |"))
            self._rows += 1
        self._row = None

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if self._skip:
            if tag in self._skip:
                del self._skip[len(self._skip) - 1 - self._skip[::-1].index(tag) :]
            elif tag in ("body", "html"):
                self._skip.clear()
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()
        elif tag in MARKS:
            self._add("", MARKS[tag])
        elif tag == "a" and self._hrefs:
            href, at = self._hrefs.pop()
            text = " ".join("".join(self._marked[at:]).split())
            if href and text and not href.startswith(("#", "javascript:")):
                self._marked[at:] = [f" [{text}]({href}) "] if self._marked[at : at + 1] and self._marked[at][:1].isspace() else [f"[{text}]({href})"]
        elif tag in BLOCKS and self._row is None:
            self._flush()
        if tag in ("ul", "ol") and self._lists:
            self._lists.pop()
        if tag in ("h1", "h2", "h3"):
            self._level = 0

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self._add(data)


def parse(html: str) -> tuple:
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser._end_row()
    parser._flush()
    seen, markdown, table = set(), [], False
    for level, line, marked in parser.lines:
        row = marked.startswith("| ")
        if line and not row and line.casefold() in seen:
            continue
        seen.add(line.casefold())
        text = f"{'#' * level} {line}" if level else marked
        if row and table:
            markdown[-1] += "\n" + text
        else:
            markdown.append(text)
        table = row
    title = " ".join(parser.title.split())
    if title and not any(line.startswith("# ") for line in markdown):
        markdown.insert(0, f"# {title}")
    return title, parser.lang, parser.canonical, len(parser.headings), parser.headings, parser.links, parser.images, "\n".join(t for _, t, _ in parser.lines if t), "\n\n".join(markdown), parser.meta, [{"kind": k, "source": v} for k, v in parser.assets]


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page; null pages are empty."""

    def rows_of(ids, pages_html):
        return ((i, *parse(h or "")) for i, h in zip(ids, pages_html, strict=True))

    return by_slices(pages.select("page_id", "html"), rows_of, SCHEMA)


def best_url(*columns: str):
    """The first known of canonical, final, source and original URL."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
