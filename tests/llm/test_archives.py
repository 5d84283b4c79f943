import gzip
import hashlib

import pytest

from quarrylake.llm import archives


def test_arc_round_trip_of_both_versions():
    records = [archives.Record("http://a/", "1.2.3.4", "19970101000000", "text/html", "200", "7", b"x\n\ny"), archives.Record("http://b/", "0.0.0.0", "199801", "text/plain", "404", "8", b"")]
    assert list(archives.parse_arc(archives.arc_bytes(records, 2))) == records
    assert [(r.url, r.payload) for r in archives.parse_arc(archives.arc_bytes(records, 1))] == [(r.url, r.payload) for r in records]
    with pytest.raises(ValueError, match="declares"):
        list(archives.parse_arc(archives.arc_bytes(records[:1], 2)[:-3]))
    spaced = archives.arc_bytes([records[0]._replace(url="http://a/b c")], 1)
    assert [r.url for r in archives.parse_arc(spaced)] == ["http://a/b c"]
    assert archives.iso_date("199801") == "1998-01-01T00:00:00Z" and archives.iso_date("19970203040506") == "1997-02-03T04:05:06Z"


def test_warc_parser_takes_any_pieces():
    records = [archives.Record(f"http://{k}/", "0.0.0.0", archives.EPOCH, "text/html", "200", str(k), f"a{k}\r\n\r\nWARC/1.1\r\n".encode() * k) for k in range(5)]
    data = "".join(archives.warc_record(r) + "\r\n\r\n" for r in records).encode()
    for size in (1, 7, 100, 10**6):
        found = list(archives.parse_warc(data[k : k + size] for k in range(0, len(data), size)))
        assert [b for _, b in found] == [r.payload for r in records]
    packed = gzip.compress(data[:100]) + gzip.compress(data[100:])
    assert b"".join(archives.inflated(memoryview(packed), 64)) == data


def test_pages_come_back(spark):
    long = "é<p>" * 60
    rows = [(1, "http://x/ y", "<p>one</p>", "k"), (2, None, None, "k"), (3, "u", long, "k"), (9, "v", long, "k"), (4, "w", long, "k"), (5, "a", "short", "k"), (6, "b", "short", "k"), (7, "c", "line\r\n\r\nline\n\n\n", "k"), (8, "d", "x" * 99, "k"), (10, "d", "x" * 99, "k"), (None, "e", long, "k"), (11, "f", "\r\n" * 200, "k")]
    for version in (1, 2):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
        got = {r.page_id: r for r in archives.archived(df, version=version).collect()}
        assert len(got) == len(rows)
        for page, _, html, _ in rows:
            payload = (html or "").encode()
            r = got[page]
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", 3) if page in (4, 9) else ("response", None))
        assert got[1].url == "http://x/%20y" and got[2].url == "urn:page:2"
    assert archives.archived(df.limit(0)).count() == 0
