"""WARC archives: a writer, and a sequential reader.

Each record is a gzip member of its own.  The reader takes a stream in chunks,
inflates member by member, finds a record's end by its Content-Length, and
checks the digests of block and payload as the bytes go by, so it holds one
chunk and one header, never a record, a member or a file.

Archives are files in a folder that all executors share, written through
pyarrow's file systems under names that no two task attempts have in common;
only the files that the finished attempts report are read.

A payload that another record already has is written as a `revisit`: its
digest and length, without the payload.  The first holder of a payload is
found by an aggregation per digest; the join back takes only digests of two or
more pages, and AQE splits it where one payload is very common.

Defined results: null html is an empty payload; a null url is an empty target;
a null page_id comes back as null, and is never the first holder unless all
are null, when each is a response; of repeated rows that hold the smallest
page_id each is a response; payloads under 100 bytes are never revisits; an
empty table writes no archive and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, scratch, table, text_or_empty
from .words import lean, ship

#: A task starts another archive after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
MOST_HEADER = 1 << 20
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:larkspur:page:"


class WarcError(ValueError):
    """A damaged archive."""


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, wbits=31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class _Members:
    """The inflated bytes of a stream of gzip members, a bounded piece at a time."""

    def __init__(self, read: Callable[[int], bytes]):
        self._read, self._raw = read, b""

    def next_member(self) -> bool:
        """Whether another member begins."""
        if not self._raw:
            self._raw = self._read(CHUNK)
        self._z = zlib.decompressobj(wbits=31)
        return bool(self._raw)

    def piece(self) -> bytes:
        """More of this member; empty at its end."""
        while not self._z.eof:
            if not self._raw:
                self._raw = self._read(CHUNK)
                if not self._raw:
                    raise WarcError("the archive ends within a record")
            try:
                out = self._z.decompress(self._raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self._raw = self._z.unused_data if self._z.eof else self._z.unconsumed_tail
            if out:
                return out
        return b""


class _Digest:
    """A running digest next to the one a header states (algorithm:value, in hex or base32); nothing stated is never wrong."""

    def __init__(self, stated: str | None):
        name, _, self.value = (stated or "").partition(":")
        self.known = bool(self.value) and name.lower().replace("-", "") in ("sha1", "sha256", "sha512", "md5")
        self._hash = hashlib.new(name.lower().replace("-", "")) if self.known else None

    def update(self, part: bytes) -> None:
        if self._hash is not None:
            self._hash.update(part)

    def wrong(self) -> bool:
        if self._hash is None:
            return False
        raw = self._hash.digest()
        return self.value.lower() != raw.hex() and self.value.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("=")


def read_records(read: Callable[[int], bytes], payloads: bool = False) -> Iterator[dict]:
    """Records of a stream: fields (lower-case names), payload_bytes, payload_digest (as stated, else SHA-256), and the payload if asked for.

    Raises WarcError if framing, length or a stated digest is wrong.
    """
    members = _Members(read)
    while members.next_member():
        held = b""

        def head(end: bytes) -> bytes:
            nonlocal held
            while end not in held:
                more = members.piece()
                if not more:
                    raise WarcError("a record ends within its header")
                if len(held) > MOST_HEADER:
                    raise WarcError("a header is too long")
                held += more
            found, _, held = held.partition(end)
            return found

        lines = head(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("a member doesn't begin with a WARC version")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"not a header line: {line[:80]!r}")
            fields[name.strip().lower()] = value.strip()
        try:
            left = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record has no Content-Length") from e
        block, payload = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest"))
        own, n, kept, http = hashlib.sha256(), 0, [], b""
        in_http = "application/http" in fields.get("content-type", "")
        while left:
            if not held:
                held = members.piece()
                if not held:
                    raise WarcError("a record is shorter than its Content-Length")
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if in_http:
                http += part
                if b"\r\n\r\n" not in http:
                    if len(http) > MOST_HEADER:
                        raise WarcError("a header is too long")
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                in_http = False
            payload.update(part)
            own.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
        while more := members.piece():
            held += more
            if len(held) > 4:
                break
        if held != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        if block.wrong():
            raise WarcError(f"block digest of {fields.get('warc-record-id')} differs")
        digest = payload.value if payload.known else own.hexdigest()
        if fields.get("warc-type") == "revisit":  # the payload stays with the record it refers to
            lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            n = int(lengths[0]) if lengths and lengths[0].isdigit() else 0
        elif payload.wrong():
            raise WarcError(f"payload digest of {fields.get('warc-record-id')} differs")
        yield {"fields": fields, "payload_bytes": n, "payload_digest": digest, "payload": b"".join(kept) if payloads else None}


def read_warc(spark: SparkSession, paths: list[str], payloads: bool = False) -> DataFrame:
    """Records of any archives (URIs), a task for each: record_id, record_type, target_uri, date, payload_bytes, payload_digest, and the payload if asked for."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream.read, payloads):
                        f = r["fields"]
                        row = {"record_id": [f.get("warc-record-id")], "record_type": [f.get("warc-type")], "target_uri": [f.get("warc-target-uri")], "date": [f.get("warc-date")], "payload_bytes": [r["payload_bytes"]], "payload_digest": [r["payload_digest"]]}
                        if payloads:
                            row["payload"] = pa.array([r["payload"]], pa.binary())
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) if k in ("record_id", "record_type", "target_uri", "date", "payload_digest") else v for k, v in row.items()})

    schema = "record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    files = spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(lean(run), schema)


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to (null for responses)."""
    body = text_or_empty("html")
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    first = keyed.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialise(first.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "shared-payloads")
    # pages held by a smaller page_id's payload are revisits
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return keyed.join(shared.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write records (page_id, url, html, refers_to) below folder (URI); path, records, bytes of each archive."""
    ship(records.sparkSession)

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(filesystem(path)[1], compression=None)
                record = encode_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, level)
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    written = records.select("page_id", "url", "html", "refers_to").mapInArrow(lean(run), "path string, records long, bytes long")
    return materialise(written, "archives")


def _page_of(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(_ID)
    return int(text) if text and text != "null" else None


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """archives (path) -> page_id, payload_bytes, payload_digest, record_type, refers_to of each record, in one pass over each file."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows: list[tuple] = []
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream.read):
                        f = r["fields"]
                        rows.append((_page_of(f.get("warc-record-id")), r["payload_bytes"], r["payload_digest"], f.get("warc-type"), _page_of(f.get("warc-refers-to"))))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_TYPES = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[n for n, _ in _TYPES])


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_archives(spark, write_archives(typed(table(spark, sf_dir, "pages")), folder))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
