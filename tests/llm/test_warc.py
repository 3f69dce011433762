import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest

from larkspur.llm import warc as w
from larkspur.llm.common import scratch

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "equal payload " * 20 + "</p>"
ROWS = [
    (5, "http://a/", BIG),
    (3, "http://b/ü\r\nX: y", BIG),
    (9, None, BIG),
    (3, "http://b2/", BIG),
    (None, "http://c/", BIG),
    (1, "http://d/", "short"),
    (2, "http://e/", "short"),
    (4, "", None),
    (6, "http://f/", ""),
    (7, "http://g/", "日本語\r\n\r\n" * 30),
    (8, "http://h/", "x" * 3_000_000),
    (10, "http://h/", "x" * 3_000_000),
    (None, None, "only null ids " * 20),
    (None, None, "only null ids " * 20),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, x in rows if (x or "") == (html or "") and j is not None), default=None)
        revisit = len(raw) >= 100 and first is not None and (i is None or i > first)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def test_awkward_pages(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    archives = w.write_archives(w.typed(pages), scratch(spark, "warc"))
    assert Counter(map(tuple, w.read_archives(spark, archives).collect())) == brute(ROWS)
    assert sum(r.records for r in archives.collect()) == len(ROWS)


def test_archives_are_cut(spark, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 600)
    pages = spark.createDataFrame([(i, "http://x/", f"page {i} " * 50) for i in range(40)], SCHEMA).coalesce(1)
    archives = w.write_archives(w.typed(pages), scratch(spark, "warc"))
    assert archives.count() > 5
    assert w.read_archives(spark, archives).count() == 40


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, w.op1_warc(spark, sf_dir).collect())) == brute(rows)


def test_empty(spark):
    archives = w.write_archives(w.typed(spark.createDataFrame([], SCHEMA)), scratch(spark, "warc"))
    assert w.read_archives(spark, archives).count() == 0


def read(data, chunk=7, payloads=True):
    stream = io.BytesIO(data)
    return list(w.read_records(lambda n: stream.read(min(n, chunk)), payloads))


def records():
    return w.encode_record(1, "http://x/", b"a\r\n\r\nb" * 99, None) + w.encode_record(2, "http://y/", b"a\r\n\r\nb" * 99, 1) + w.encode_record(3, None, b"", None)


def test_reader_in_small_chunks():
    got = read(records())
    assert [r["payload"] for r in got] == [b"a\r\n\r\nb" * 99, b"", b""]
    assert [r["payload_bytes"] for r in got] == [594, 594, 0]
    assert got[1]["fields"]["warc-refers-to"] == "<urn:larkspur:page:1>"


def test_each_record_is_a_member():
    z = zlib.decompressobj(wbits=31)
    assert z.decompress(records()).startswith(b"WARC/1.1") and z.eof and z.unused_data


def foreign(kind, block, **fields):
    head = "WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "WARC_Record_ID": "<urn:uuid:0>", **fields, "Content_Length": len(block)}.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_foreign_archives(spark, tmp_path):
    """Records of other writers: other kinds, no digests, SHA-1 in base32."""
    import base64

    body = b"<html>hi</html>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    data = foreign("warcinfo", b"software: x\r\n") + foreign("response", http + body, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=sha1, WARC_Target_URI="http://x/") + foreign("revisit", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=sha1)
    got = read(data)
    assert [r["payload"] for r in got] == [b"software: x\r\n", body, b""]
    wrong = foreign("response", http + b"other", Content_Type="application/http", WARC_Payload_Digest=sha1)
    with pytest.raises(w.WarcError):
        read(wrong)
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = w.read_warc(spark, [f"file://{tmp_path}/a.warc.gz"], payloads=True).collect()
    assert [(r.record_type, r.target_uri, r.payload_bytes) for r in rows] == [("warcinfo", None, 13), ("response", "http://x/", 15), ("revisit", None, 0)]
    assert bytes(rows[1].payload) == body


def damaged():
    one = gzip.decompress(w.encode_record(1, "http://x/", b"payload", None))
    again = lambda x: gzip.compress(x)
    yield records()[:-5]  # cut off
    yield again(one.replace(b"payload\r\n", b"paxload\r\n"))  # digest
    yield again(one[:-4])  # no end
    yield again(one + b"more")  # longer than stated
    yield again(one.replace(b"WARC/1.1", b"JUNK/1.1"))
    yield again(one.replace(b"\r\nContent-Length: ", b"\r\nContent-Lengt: ", 1))
    yield b"not gzip at all"
    yield again(b"WARC/1.1\r\nbroken")


@pytest.mark.parametrize("data", list(damaged()))
def test_damage_is_an_error(data):
    with pytest.raises(w.WarcError):
        read(data)
