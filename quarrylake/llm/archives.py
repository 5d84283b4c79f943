"""Legacy archive conversion: ARC records to WARC.

ARC has one header line a record and then as many bytes as that line declares.  Version 1 lines have five
fields (URL, IP address, date, content type, length), version 2 lines ten (URL, IP address, date, content
type, result code, checksum, location, offset, file name, length); the first record of a file, whose URL
begins with ``filedesc:``, says which.  From each record the converter makes a WARC record: a record id
(a name-based UUID of the record's content and place, so reruns agree), the date in ISO form, the type,
the digests and the length.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes: the one with the smallest page id is the
response, the others are revisits of it without the payload.  Digests are compared as narrow rows; the
payloads are not shuffled, as only the revisits' ids are joined back (broadcast after a count, else
by a shuffle of the pages).

Archives are written by Spark's text writer, gzip-compressed: a WARC record of UTF-8 text is a header, an
empty line, the block and two line breaks, which is one row and the writer's separator.  So archives may
lie in any store, and a lost task leaves nothing behind.  They are read back as bytes, in pieces, by declared lengths.

Defined cases: null payloads are empty; null URLs are written as ``urn:page:<id>``, white space in URLs is
percent-encoded; null ids are written as ``-`` and never are what others refer to; rows that repeat the
smallest id and payload are all responses; empty tables give no records; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh_path, materialize

REVISIT_BYTES = 100
#: Records of one archive, bytes of ARC made at once.
ARCHIVE_RECORDS, ARC_BYTES = 5000, 4 << 20
EPOCH = "20200101000000"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-conversion")
CRLF = "\r\n"
#: Fields of the header lines by version (fixed by the format).
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "name", "length"),
}


class Record(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    result: str
    name: str
    payload: bytes


# ------------------------------------------------------------------------------------------------- ARC


def arc_bytes(records: Iterable[Record], version: int = 2) -> bytes:
    """An ARC file of some records."""
    about = f"{version} 0 quarrylake\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'result': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'name': 'Filename', 'length': 'Archive-length'}[k] for k in FIELDS[version])}\n".encode()
    out, size = [], 0
    first = Record("filedesc://pages.arc", "0.0.0.0", EPOCH, "text/plain", "200", "pages.arc", about)
    for r in (first, *records):
        values = {"url": r.url, "ip": r.ip, "date": r.date, "type": r.type, "result": r.result, "checksum": "-", "location": "-", "offset": str(size), "name": r.name, "length": str(len(r.payload))}
        head = (" ".join(values[k] for k in FIELDS[version]) + "\n").encode()
        out += (head, r.payload, b"\n")
        size += len(head) + len(r.payload) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[Record]:
    """Records of an ARC file, by the fields of its version and the declared lengths."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode().rstrip("\r").split(" ")
        if version is None:
            if not fields[0].startswith("filedesc:") or len(fields) not in map(len, FIELDS.values()):
                raise ValueError("an ARC file begins with a filedesc record")
            length = int(fields[-1])
            version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])
            if version not in FIELDS or len(fields) != len(FIELDS[version]):
                raise ValueError(f"ARC version {version} doesn't go with {len(fields)} fields")
            at = end + 1 + length
            continue
        if len(fields) < len(FIELDS[version]):
            raise ValueError(f"an ARC header line has {len(fields)} of {len(FIELDS[version])} fields")
        # Old writers left spaces in URLs: what is too much belongs to the first field.
        spare = len(fields) - len(FIELDS[version])
        named = dict(zip(FIELDS[version], [" ".join(fields[: spare + 1]), *fields[spare + 1 :]], strict=True))
        length = int(named["length"])
        payload = data[end + 1 : end + 1 + length]
        if length < 0 or len(payload) != length:
            raise ValueError(f"an ARC record declares {length} bytes and has {len(payload)}")
        yield Record(named["url"], named["ip"], named["date"], named["type"], named.get("result", "200"), named.get("name", "-"), payload)
        at = end + 1 + length


# ------------------------------------------------------------------------------------------------ WARC


def iso_date(date: str) -> str:
    """ARC dates have 12 or 14 digits (some only 8); missing parts are the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(url: str, date: str, name: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, name, digest)))}>"


def warc_record(r: Record, refers_to: str | None = None) -> str:
    """The WARC record of an ARC record, without the two line breaks at its end."""
    digest = hashlib.sha256(r.payload).hexdigest()
    body = r.payload.decode() if refers_to is None else ""
    block = hashlib.sha256(r.payload).hexdigest() if refers_to is None else hashlib.sha256(b"").hexdigest()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(r.url, r.date, r.name, digest)}",
        f"WARC-Date: {iso_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{block}",
        f"X-Source-Name: {r.name}",
        f"X-Payload-Length: {len(r.payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Name: {refers_to}"]
    head += [f"Content-Type: {r.type}", f"Content-Length: {len(body.encode())}"]
    return CRLF.join(head) + CRLF + CRLF + body


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths; holds one record and one piece at most."""
    held, more = bytearray(), iter(pieces)

    def fill() -> bool:
        piece = next(more, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("a WARC file ends inside a header")
                return
        lines = held[:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"a WARC record begins with {lines[0][:20]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        while len(held) < stop + 4:
            if not fill():
                if len(held) < stop:
                    raise ValueError("a WARC file ends inside a block")
                break
        block = bytes(held[end + 4 : stop])
        del held[: stop + 4]
        yield fields, block


def inflated(data: memoryview, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a gzip file of any number of members; other files as they are."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[k : k + size]) for k in range(0, len(data), size))
        return
    while len(data):
        stream, k = zlib.decompressobj(31), 0
        while not stream.eof and k < len(data):
            yield stream.decompress(data[k : k + (size >> 3)])
            k += size >> 3
        if not stream.eof:
            raise ValueError("a gzip member is cut short")
        rest = len(stream.unused_data)
        data = data[min(k, len(data)) - rest :]


# ----------------------------------------------------------------------------------------------- tables


def _revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that revisit another."""
    narrow = pages.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", F.sha2("html", 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2) -> None:
    """Write all pages, by way of ARC records, to WARC files in a folder."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    revisits = materialize(_revisits(rows).distinct(), "revisits")
    named = rows.withColumn("digest", F.sha2("html", 256)).join(bounded(revisits, revisits.count(), 500_000), ["page_id", "digest"], "left")
    def convert(batches):
        for batch in batches:
            held, size = [], 0
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")), strict=True):
                name = "-" if page is None else str(page)
                target = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{name}"
                payload = html.encode("utf-8", "replace")
                held.append((Record(target, "0.0.0.0", EPOCH, "text/html", "200", name, payload), refers))
                size += len(payload)
                if size >= ARC_BYTES:
                    yield _converted(held, version)
                    held, size = [], 0
            if held:
                yield _converted(held, version)

    out = named.select("page_id", "url", "html", F.col("refers_to").cast("string")).mapInArrow(convert, "value string")
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _converted(held: list[tuple[Record, str | None]], version: int) -> pa.RecordBatch:
    """Through an ARC file, as its records come back from it."""
    parsed = parse_arc(arc_bytes([r for r, _ in held], version))
    if version == 1:  # has no field for the name
        parsed = (r._replace(name=own.name) for r, (own, _) in zip(parsed, held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([warc_record(r, refers) for r, (_, refers) in zip(parsed, held, strict=True)], pa.string())], names=["value"])


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of all archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id``.

    With ``payloads`` also ``payload``.  Digests of blocks are compared with their headers.
    """

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_warc(inflated(memoryview(content.as_buffer()))):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
                        raise ValueError(f"the block of {fields['WARC-Record-ID']} is not what its digest says")
                    name, refers = fields["X-Source-Name"], fields.get("X-Refers-To-Name")
                    length = len(block) if kind == "response" else int(fields["X-Payload-Length"])
                    rows.append((None if name == "-" else int(name), length, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Record-ID"], *([block] if payloads else [])))
                    size += len(block) if payloads else 0
                    if len(rows) >= 5000 or size >= ARC_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, schema)


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2) -> DataFrame:
    """Write the archives and return what reading them gives."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col, version)
    return read(pages.sparkSession, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
