"""Text functions as Columns: folding, tokens, ids, similarity.  All run inside the JVM unless noted."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TOKEN = r"[\p{L}\p{N}_]+"


def _fold_table() -> tuple[str, str]:
    """Letters with marks and their plain forms, by Unicode decomposition (and d for the barred d)."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without accents (combining marks dropped), white space collapsed: for retrieval."""
    return collapse(F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{M}+", ""))


def tokens(c: Column) -> Column:
    """Folded word tokens; digits and underscores belong to words."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def plain_key(c: Column) -> Column:
    """Folded, everything but a-z and 0-9 a space: for comparing statements."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def graph_key(c: Column) -> Column:
    """Lower case and collapsed, accents kept: for entity surfaces."""
    return F.lower(collapse(c))


#: What Python's ``str.split`` takes for white space, and characters of no width.
SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"


def dedup_text(c: Column) -> Column:
    """NFKC, zero-width characters dropped, case-folded, collapsed.

    By the ICU library that Spark brings with it, so no text goes to Python; a character newer than Python's Unicode tables
    is folded here and is not by ``str.casefold``.
    """
    icu = lambda owner, method, x: F.reflect(F.lit(f"com.ibm.icu.{owner}"), F.lit(method), x, F.lit(True))
    composed = icu("text.Normalizer", "compose", F.coalesce(c, F.lit("")))
    folded = icu("lang.UCharacter", "foldCase", F.regexp_replace(composed, NO_WIDTH, ""))
    return F.when(c.isNotNull(), F.trim(F.regexp_replace(folded, SPACES, " ")))


def dedup_text_latin(c: Column) -> Column:
    """The same for text without compatibility characters, inside the JVM."""
    return F.lower(collapse(F.regexp_replace(c, "[​‌‍⁠﻿]", "")))


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def short_id(prefix: str, c: Column, n: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, n))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "main").otherwise(s)


def chunk_id(kind: Column, source: Column, section: Column, index: Column) -> Column:
    return F.concat_ws("_", kind, F.substring(F.sha2(source, 256), 1, 12), slug(section), F.concat(F.lit("c"), F.lpad(index.cast("string"), 3, "0")))


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles joined by spaces; fewer words are one shingle, none are none."""
    several = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, several).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def char_grams(c: Column, n: int = 3) -> Column:
    """Character n-grams of the despaced text between two pads of two spaces."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(c), r"\s+", ""), F.lit("  "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-10, F.lit(0.0)).otherwise(dot(a, b) / size)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash64(words: list[str], shingle: int = 4) -> int:
    """Signed 64-bit SimHash of word shingles; no words give 0, ties give 1."""
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    low = np.frombuffer(b"".join(hashlib.sha256(g.encode()).digest()[-8:] for g in grams), ">u8")
    bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(0, dtype=np.int64) - len(grams)
    return int(np.packbits(votes >= 0).view(">i8")[0])


@F.pandas_udf(LongType())
def simhash(words: pd.Series) -> pd.Series:
    return words.map(lambda w: simhash64([] if w is None else list(w)))


def number(c: Column) -> Column:
    """Numbers as written: with both marks the comma is decimal; a lone comma is decimal; dots in threes group."""
    both = c.contains(".") & c.contains(",")
    text = F.when(both, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(c.contains(","), F.replace(c, F.lit(","), F.lit("."))).when(c.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    return text.try_cast("double")


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s) != "")


def citation_markers(c: Column) -> Column:
    """Numbers n of the marks [n], in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def url_domain(c: Column) -> Column:
    return F.parse_url(c, F.lit("HOST"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
