"""Language identification by compression: the language whose dictionary packs a text smallest.

Texts are folded first: lower case, and one space for each run of ASCII that isn't letters.  For each
language a raw-content zstandard dictionary is cut from sample texts of it.  A text is cut into
blocks of at most ``BLOCK`` bytes, each block is compressed with every dictionary, and the language with
the smallest total wins.  Blocks keep the dictionaries at work all through a long text.  The score is the
share of the winner when every byte saved halves the odds of the others; where the runner-up is closer
than ``MARGIN`` of the smallest total, or by less than ``MARGIN_BYTES``, the decision is marked rejected.

Every language present is learned, from pieces of at most ``PIECE`` characters of its texts (one of each
different text, from a place that its hash names), until its dictionary is full or its texts are all used.
Dictionaries have ``DICTIONARY`` bytes, or less where so many languages would go over ``BUDGET`` together:
the bound on driver and workers.  Which rows may be learned from is up to the caller.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; with no
language learned every text is; ties go to the language with most rows to learn from, then to the first by code point; rows are judged one by one,
so repeated rows agree; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Bytes of a dictionary and of all, characters of a sample, bytes of a block.
DICTIONARY, BUDGET, PIECE, BLOCK = 96 << 10, 6 << 20, 4096, 4096
LEVEL = 9
MARGIN, MARGIN_BYTES = 0.002, 1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())

SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean, margin double"


def learn(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary of each language, most frequent first, from a bounded sample of the given rows."""
    rows = samples.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.sum(F.least(F.octet_length("text"), F.lit(PIECE))).alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    dictionary = min(dictionary, max(1 << 10, BUDGET // max(1, len(sizes))))
    found: dict[str, bytearray] = {r.lang: bytearray() for r in sizes}
    # Texts by hash, so that about three dictionaries' worth is looked at; more where copies leave less than one.
    share = {r.lang: min(1.0, 3.0 * dictionary / r.bytes) for r in sizes}
    turn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    while share:
        shares = rows.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
        wanted = rows.join(F.broadcast(shares), "lang").where(turn < F.col("share"))
        picked = wanted.select("lang", F.substring("text", place, F.lit(PIECE)).alias("piece"), turn.alias("turn")).distinct().orderBy("turn", "lang", "piece")
        for lang in share:
            found[lang] = bytearray()
        for row in picked.toLocalIterator():
            own = found[row.lang]
            if len(own) < dictionary:
                own += folded(row.piece) + b" "
        share = {k: min(1.0, 8 * v) for k, v in share.items() if v < 1 and len(found[k]) < dictionary}
    return {lang: bytes(text[:dictionary]) for lang, text in found.items() if text}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        packers = []
        for lang in self.langs:
            words = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.packers = packers

    def sizes(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.packers), np.int64)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            total += [len(p.compress(block)) for p in self.packers]
        return total

    def judge(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, whether it is rejected, and the margin to the next language."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True, 0.0
        sizes = self.sizes(folded(text))
        order = np.argsort(sizes, kind="stable")
        best = int(sizes[order[0]])
        score = float(1.0 / np.exp2(-np.minimum(sizes - best, 1000.0)).sum())
        if len(order) == 1:
            return self.langs[0], score, False, 1.0
        gap = int(sizes[order[1]]) - best
        return self.langs[order[0]], score, gap < max(MARGIN_BYTES, MARGIN * best), gap / best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, rejected, margin``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # BUDGET bytes at most, or 1 KB a language

    @kernel.tidy
    def classify(batches):
        classifier = _classifier(shared.value)
        for batch in batches:
            found = [classifier.judge(x.as_py()) for x in batch.column(1)]
            lang, score, rejected, margin = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(margin, pa.float64())], names=["doc_id", "lang_pred", "score", "rejected", "margin"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(classify, SCHEMA)


def _classifier(dictionaries: dict[str, bytes]) -> Classifier:
    key = ("languages", *((k, zlib.crc32(v)) for k, v in dictionaries.items()))
    return kernel.held(key, lambda: Classifier(dictionaries))


def fold(id_col: str = "doc_id", n: int = 4):
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is decided, in their own columns and order of columns.

    Rejected are texts that are null or without letters, and those where two languages tie.
    """
    dictionaries = learn(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @kernel.tidy
    def keep(batches):
        classifier = _classifier(shared.value)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(text_col) if at is None else at
            yield batch.filter(pa.array([not classifier.judge(x.as_py())[2] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
