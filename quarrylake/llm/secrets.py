"""Secret scan with multipart credential linking.

Base findings stand by themselves: ``assign`` (a named value), ``access`` (an access key id) and ``hex``
(a long lower-case hexadecimal run).  Many credentials, though, come in parts that say little alone: an
access identifier, a secret and an endpoint.  The scan also collects weak candidates for each part:

* identifiers: base ``access`` findings, shorter ``AKIA`` runs, and values named id, user or login (``weak_id``);
* secrets: base ``assign`` and ``hex`` findings, and runs of 16 or more letters, digits and base64 signs that mix lower
  case, upper case and digits or have ``_LEAST_BITS`` of entropy a character, other than names of values (``weak_secret``);
* endpoints: URLs and host:port pairs (``endpoint``).

A part's scope is ``REACH`` characters to either side, line breaks included (credentials are often written
one part a line).  Parts are joined by interval: a weak
identifier is reported only if a secret lies in its scope, a weak secret only if an identifier does, an
endpoint only if both do.  The join sorts starts and ends within each text (each document is a partition
of its own, so nothing is shuffled) and looks up whether a complement overlaps: n log n in the parts, no pairs.

Spans are in code points, ends exclusive.  A weak span that overlaps a base span is that base span and not
reported again.

Defined cases: null and empty texts have no spans; null ids are kept; rows are judged one by one, so
repeated rows agree; further columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 120
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join((_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as the long ones among all maximal runs
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_ONE_CLASS = re.compile(r"[a-z+/_-]+|[A-Z+/_-]+|[0-9+/_-]+")
_NAME = re.compile(r"""[A-Za-z+/_-]+["']?[\x20\t]*[:=][\x20\t]*["']?[^\s"'=]""")  # a digitless run with a value after it
_LEAST_BITS = 3.0
_WEAK_ID = re.compile(r"""(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_URL = re.compile(r"https?://[^\s\"'<>]{4,}")
_HOST_PORT = re.compile(r"(?<![a-z0-9.-])([a-z0-9.-]++):\d{2,5}\b")
_TOP = re.compile(r"[a-z]{2,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, without those that are too short."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _bits(run: str) -> float:
    """Shannon entropy of a character."""
    return math.log2(len(run)) - sum(n * math.log2(n) for n in Counter(run).values()) / len(run)


def _weak_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    ids = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() < 20] if "AKIA" in text else []
    ends = []
    if "=" in text or ":" in text:
        ids += [m.span() for m in _WEAK_ID.finditer(text)]
    if ":" in text:
        ends = [m.span() for m in _URL.finditer(text)]
        held = np.array(ends, np.int64).reshape(-1, 2)
        hosts = [x for m in _HOST_PORT.finditer(text) if (x := _host(text, m))]
        ends += [x for x, inside in zip(hosts, _overlaps(np.array(hosts, np.int64).reshape(-1, 2), held), strict=True) if not inside]
    secrets = [m.span() for m in _RUN.finditer(text) if (not _ONE_CLASS.fullmatch(m[0]) or _bits(m[0]) >= _LEAST_BITS) and not _NAME.match(text, m.start())]
    return ids, secrets, ends


def _host(text: str, m: re.Match) -> tuple[int, int] | None:
    """The span of a host of two names or more and its port; names run up to an empty one or a letter that is none of theirs."""
    labels = m[1].split(".")
    if not _TOP.fullmatch(labels[-1]):
        return None
    own = labels[len(labels) - next((k for k, x in enumerate(reversed(labels)) if not x), len(labels)) :]
    if len(own) == len(labels) and m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
        own = own[1:]
    name = ".".join(own).lstrip("-")
    return (m.end(1) - len(name), m.end()) if name.count(".") else None


def _overlaps(spans: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which spans overlap any of the others: as many have begun by the end as have ended by the start, or not."""
    if not len(spans) or not len(others):
        return np.zeros(len(spans), dtype=bool)
    begun = np.searchsorted(np.sort(others[:, 0]), spans[:, 1], side="left")
    ended = np.searchsorted(np.sort(others[:, 1]), spans[:, 0], side="right")
    return begun > ended


def _scopes(spans: np.ndarray) -> np.ndarray:
    """Each span widened by REACH characters to either side, whatever lines they are on."""
    return spans + np.array([-REACH, REACH])


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts co-occur in their scope."""
    found = [np.array(x, np.int64).reshape(-1, 2) for x in _weak_spans(text)]
    if not any(map(len, found)):
        return []
    known = np.array([x[:2] for x in base], np.int64).reshape(-1, 2)
    ids, secrets, ends = (x[~_overlaps(x, known)] for x in found)
    ids = ids[~_overlaps(ids, ends)]
    secrets = secrets[~_overlaps(secrets, np.concatenate([ids, ends]))]
    all_ids = np.concatenate([np.array([x[:2] for x in base if x[2] == "access"], np.int64).reshape(-1, 2), ids])
    all_secrets = np.concatenate([np.array([x[:2] for x in base if x[2] != "access"], np.int64).reshape(-1, 2), secrets])
    if not len(all_ids) or not len(all_secrets):
        return []
    out = []
    for spans, kind, needs in ((ids, "weak_id", (all_secrets,)), (secrets, "weak_secret", (all_ids,)), (ends, "endpoint", (all_ids, all_secrets))):
        scopes = _scopes(spans)
        keep = np.ones(len(spans), dtype=bool)
        for others in needs:
            keep &= _overlaps(scopes, others)
        out += [(a, b, kind) for a, b in spans[keep].tolist()]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base kinds, a digest of the base spans, all spans, and how many were linked."""

    def find(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                linked = linked_spans(text, base)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked), len(linked)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, SCHEMA)
