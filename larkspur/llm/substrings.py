"""Substring deduplication over super-k-mers.

A window is WINDOW consecutive words.  Its minimiser is the least of the runs
of GRAM words in it, in an order by hash in which hot runs come last.
Consecutive windows that share their minimiser travel as one packed string (the
words they span) to the bucket of that minimiser; equal windows have equal
minimisers, so they meet there.  In a bucket, strings alone with their
minimiser need no look at all; of the others, windows are sorted by a hash,
windows with equal hashes are compared word by word, and each distinct window
gets the smallest doc_id it starts in.

Three readings of the documents, each a pure function of its input split:
1. totals, and the hot runs: those with HOT_SHARE of all runs;
2. packed strings to the buckets (equal strings of a task travel once);
3. keys of the strings of each document, joined with what the buckets found.
Then each document meets its found windows once, to drop the covered words.

Hot groups: a passage that many documents share consists of hot runs.  Windows
that reach out of it hold others, and go by those, so they spread with the
texts around it; windows within it are the same strings everywhere, which a
task sends once.  The order changes where a window goes, not the number of
strings.  There are at most 2 / HOT_SHARE hot runs, which is what every task
gets to know.  A bucket's windows are sorted PASS_WINDOWS at a time, in passes
by hash.  Strings that many documents share are joined by key, which AQE splits
when skewed.

Defined results: null texts have no words; a null doc_id is neither smaller
nor larger than another, so such a document keeps all its words; repeated rows
do not repeat each other (their doc_id is not smaller); documents of fewer
words than a window keep all; empty tables give no rows; further columns are
ignored or carried along.  doc_id is an integer.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import materialise, table
from .words import MASK, covered, lean, mixed, ship, sliding_min, token_hashes, tokens, windows

WINDOW = 50
GRAM = 8
#: A super-k-mer is cut after so many windows, so that a bit of a long stands for each.
MOST_WINDOWS = 64
#: A run of words with at least this share of all runs is hot; half of the share is looked for in each block of runs.
HOT_SHARE, HOT_BLOCK = 1 / 100_000, 1 << 22
#: Windows that are sorted at once.
PASS_WINDOWS = 1 << 21
#: Windows to a bucket, and the most partitions that buckets are dealt to.
BUCKET_WINDOWS = 600_000
MOST_PARTITIONS = 20_000
#: Bytes of strings that a task holds before it sends them.
FLUSH_BYTES = 32 << 20


class Hot:
    """Runs of words, by hash, that come last in the order of minimisers."""

    def __init__(self, hashes=()):
        self.known = np.array(sorted(hashes), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def order(self, grams: np.ndarray) -> np.ndarray:
        """A value of each run: the hash without its last bit, and above it whether the run is hot."""
        out = grams >> np.uint64(1)
        if len(self.known):
            at = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
            some = grams[at]
            hot = self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] == some
            out[at[hot]] |= np.uint64(1 << 63)
        return out


def super_kmers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM, hot: Hot | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word hashes: the minimiser, first window and number of windows of each run."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_min((hot or Hot()).order(windows(h, gram)), window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(first, len(least)))
    if size.max() > MOST_WINDOWS:  # cut long runs
        parts = -(-size // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run = np.repeat(np.arange(len(size)), parts)
        at = first[run] + nth * MOST_WINDOWS
        size = np.minimum(MOST_WINDOWS, size[run] - nth * MOST_WINDOWS)
        first = at
    return least[first], first, size


def _tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return tokens(text.encode("utf-8", "surrogatepass") if text else b"")


def cut(text: str | None, hot: Hot, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Minimisers, first windows and packed strings of a text."""
    joined, starts = _tokens(text)
    route, first, size = super_kmers(token_hashes(joined, starts), window, hot=hot)
    if not len(route):
        return route, first, []
    ends = np.append(starts[1:] - 1, len(joined))
    data = joined.tobytes()
    return route, first, [data[a:b] for a, b in zip(starts[first].tolist(), ends[first + size + window - 2].tolist(), strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def survey(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[int, list[int]]:
    """The number of windows, and the hot runs.

    Of each block of its runs, a task names those with HOT_SHARE / 2 of the block.  One with
    HOT_SHARE of all runs gathers at least half of that in blocks that name it, and one that gathers
    as much is taken as hot, so none is missed and at most 2 / HOT_SHARE are found.
    """
    ship(docs.sparkSession)

    def run(batches):
        held, n, windows_seen, runs_seen = [], 0, 0, 0

        def named():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            heavy = counts >= max(2, n * HOT_SHARE / 2)
            return pa.RecordBatch.from_pydict({"key": pa.array(keys[heavy].view(np.int64)), "runs": pa.array(counts[heavy]), "windows": pa.array(np.zeros(int(heavy.sum()), np.int64))})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                joined, starts = _tokens(text)
                if len(starts) < window:
                    continue
                windows_seen += len(starts) - window + 1
                runs_seen += len(starts) - gram + 1
                held.append(windows(token_hashes(joined, starts), gram))
                n += len(held[-1])
                if n >= HOT_BLOCK:
                    yield named()
                    held, n = [], 0
        if n:
            yield named()
        yield pa.RecordBatch.from_pydict({"key": pa.array([None], pa.int64()), "runs": pa.array([runs_seen], pa.int64()), "windows": pa.array([windows_seen], pa.int64())})

    found = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(lean(run), "key long, runs long, windows long")
    sums = materialise(found.groupBy("key").agg(F.sum("runs").alias("runs"), F.sum("windows").alias("windows")), "hot-runs")
    total = sums.filter("key IS NULL").first()
    if total is None:
        return 0, []
    least = max(2, total["runs"] * HOT_SHARE / 2)
    return total["windows"], [r["key"] & MASK for r in sums.filter(F.col("key").isNotNull() & (F.col("runs") >= least)).select("key").collect()]


_HEAD = struct.Struct("<q")


def _pack(entries: list[tuple[int, int, int, bytes]], zip_: zstandard.ZstdCompressor) -> bytes:
    """Entries (route, least doc, largest doc, string) as one compressed blob."""
    route, low, high, strings = zip(*entries, strict=True)
    return zip_.compress(
        b"".join(
            (_HEAD.pack(len(entries)), np.array(route, np.uint64).tobytes(), np.array(low, np.int64).tobytes(), np.array(high, np.int64).tobytes(), np.fromiter(map(len, strings), np.int32, len(strings)).tobytes(), *strings)
        )
    )


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = _HEAD.unpack_from(raw)[0], _HEAD.size
    route, low, high = (np.frombuffer(raw, t, n, at + 8 * n * i) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    ends = np.cumsum(np.frombuffer(raw, np.int32, n, at + 24 * n)) + at + 28 * n
    starts = np.concatenate(([at + 28 * n], ends[:-1]))
    return route, low, high, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _packed(docs: DataFrame, hot: list[int], buckets: int, window: int) -> DataFrame:
    """bucket, blob: the super-k-mers of all documents; equal strings of a flush are sent once."""
    hashes = np.array(hot, np.uint64)

    def run(batches):
        last, zip_ = Hot(hashes), zstandard.ZstdCompressor(level=3)
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0

        def flush():
            nonlocal size
            by: dict[int, list] = {}
            keys = np.array([k[0] for k in held], np.uint64)
            to = (mixed(keys) % np.uint64(buckets)).tolist()
            for b, ((route, string), (low, high)) in zip(to, held.items(), strict=True):
                by.setdefault(b, []).append((route, low, high, string))
            held.clear()
            size = 0
            for some in _slices(sorted(by), 64):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_pack(by.pop(b), zip_) for b in some], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                routes, _, strings = cut(text, last, window)
                for route, string in zip(routes.tolist(), strings, strict=True):
                    have = held.get((route, string))
                    if have is None:
                        held[route, string] = [doc_id, doc_id]
                        size += len(string) + 200
                    elif doc_id < have[0]:
                        have[0] = doc_id
                    elif doc_id > have[1]:
                        have[1] = doc_id
                if size >= FLUSH_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(run), "bucket long, blob binary")


def _slices(x: list, n: int):
    return (x[i : i + n] for i in range(0, len(x), n))


def _instances(docs: DataFrame, hot: list[int], window: int) -> DataFrame:
    """k1, k2 (key of the string), doc_id, mark, first (window) of every super-k-mer."""
    hashes = np.array(hot, np.uint64)

    def run(batches):
        last = Hot(hashes)
        for batch in batches:
            found = [cut(text, last, window) for text in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            if not len(of):
                continue
            k1, first = (np.concatenate([x[i] for x in found]) for i in range(2))
            k2 = np.fromiter((xxhash.xxh3_64_intdigest(string) for x in found for string in x[2]), np.uint64, len(of))
            columns = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(first.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc_id", "mark", "first"])

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(lean(run), "k1 long, k2 long, doc_id long, mark long, first int")


def bucket_minima(entries, window: int = WINDOW):
    """entries: arrays and lists (route, low, high, string) of one bucket, in parts.

    Yields (route, string, least doc_id of each window) for strings of which some document may lose words.
    """
    route, low, high = (np.concatenate([e[i] for e in entries]) for i in range(3))
    strings = [s for e in entries for s in e[3]]
    order = np.argsort(route, kind="stable")
    ordered = route[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(starts, len(ordered)))
    alone = order[starts[sizes == 1]]
    for i in alone[low[alone] < high[alone]].tolist():
        s = strings[i]
        yield int(route[i]), s, np.full(s.count(b" ") + 2 - window, low[i])
    shared: list[tuple[int, bytes, int, int]] = []
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        merged: dict[bytes, list[int]] = {}
        for i in order[a : a + n].tolist():
            have = merged.setdefault(strings[i], [int(low[i]), int(high[i])])
            have[0], have[1] = min(have[0], int(low[i])), max(have[1], int(high[i]))
        if len(merged) == 1:
            (s, (lo, hi)), r = *merged.items(), int(ordered[a])
            if lo < hi:
                yield r, s, np.full(s.count(b" ") + 2 - window, lo)
        elif min(x[0] for x in merged.values()) < max(x[1] for x in merged.values()):
            shared += [(int(ordered[a]), s, lo, hi) for s, (lo, hi) in merged.items()]
    del strings
    if shared:
        yield from _shared_minima(shared, window)


def _string_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each window of each string, and where in its string it begins and ends."""
    joined = np.frombuffer(b" ".join(strings), np.uint8)
    gaps = np.flatnonzero(joined == 0x20)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(joined))
    words = np.array([s.count(b" ") + 1 for s in strings])
    before = np.cumsum(words) - words  # words of the strings before
    count = words - window + 1
    own = np.repeat(before - (np.cumsum(count) - count), count) + np.arange(count.sum())  # the first word of each window
    base = np.repeat(starts[before], count)
    return windows(token_hashes(joined, starts), window)[own], starts[own] - base, ends[own + window - 1] - base


def _shared_minima(shared, window: int):
    """Windows of several strings, sorted by hash; windows of one hash are compared word by word.

    shared: (route, string, smallest doc, largest doc).  At most PASS_WINDOWS windows or so are held, in passes by hash.
    """
    count = np.array([s.count(b" ") + 2 - window for _, s, _, _ in shared])
    at = np.concatenate(([0], np.cumsum(count)))
    minima = np.empty(at[-1], np.int64)
    of = np.repeat(np.arange(len(shared)), count)
    low = np.array([x[2] for x in shared], np.int64)
    passes = -(-int(at[-1]) // PASS_WINDOWS)
    edges = np.unique(np.append(np.searchsorted(at, np.arange(0, at[-1], PASS_WINDOWS)), len(shared))).tolist()
    for p in range(passes):
        parts = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            every, begin, end = _string_windows([x[1] for x in shared[a:b]], window)
            mine = np.flatnonzero(every % np.uint64(passes) == p) if passes > 1 else np.arange(len(every))
            parts.append((every[mine], begin[mine], end[mine], mine + at[a]))
        every, begin, end, which = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(every):
            continue
        order = np.argsort(every, kind="stable")
        group = np.empty(len(every), np.int64)
        ordered = every[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        group[order] = np.cumsum(new) - 1
        heads = order[np.flatnonzero(new)][group[order]]

        def words_of(i: int) -> bytes:
            return shared[of[which[i]]][1][begin[i] : end[i]]

        # exactness: every window must equal the first of its hash; any that does not goes by its words
        strays: dict[bytes, int] = {}
        more = int(new.sum())
        for i, j in zip(order[~new].tolist(), heads[~new].tolist(), strict=True):
            w = words_of(i)
            if w != words_of(j):
                group[i] = strays.setdefault(w, more)
                more = max(more, int(group[i]) + 1)
        least = np.full(more, np.iinfo(np.int64).max)
        np.minimum.at(least, group, low[of[which]])
        minima[which] = least[group]
    for i, (route, s, _, high) in enumerate(shared):
        own = minima[at[i] : at[i + 1]]
        if (own < high).any():
            yield route, s, own


def _resolve(packed: DataFrame, buckets: int, window: int) -> DataFrame:
    """k1, k2, least: for strings with repeats, the smallest doc_id of each of their windows."""
    partitions = min(buckets, MOST_PARTITIONS)

    def run(batches):
        current, parts = None, []

        def done():
            for some in _chunks(bucket_minima(parts, window), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([x[0] for x in some], np.uint64).view(np.int64)),
                        pa.array(np.array([xxhash.xxh3_64_intdigest(x[1]) for x in some], np.uint64).view(np.int64)),
                        pa.array([x[2] for x in some], pa.list_(pa.int64())),
                    ],
                    names=["k1", "k2", "least"],
                )

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != current and parts:
                    yield from done()
                    parts.clear()
                current = bucket
                parts.append(_unpack(blob.as_py()))
        if parts:
            yield from done()

    dealt = packed.repartitionById(partitions, F.pmod(F.col("bucket"), F.lit(partitions)).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(run), "k1 long, k2 long, least array<long>")


def _chunks(it, n: int):
    some = []
    for x in it:
        some.append(x)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, mark (hash of the text), spans: array of (first, mask); bit i of a mask marks window first + i as repeated."""
    n_windows, hot = survey(docs, window)
    buckets = max(1, math.ceil(n_windows / BUCKET_WINDOWS))
    found = materialise(_resolve(_packed(docs, hot, buckets, window), buckets, window), "repeated-strings")
    mask = F.expr("aggregate(transform(least, (x, i) -> if(x < doc_id, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    hit = _instances(docs, hot, window).join(found, ["k1", "k2"]).select("doc_id", "mark", "first", mask.alias("mask")).filter("mask <> 0")
    return hit.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "mask")).alias("spans"))


def removed_words(n: int, first: np.ndarray, mask: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words a repeated window covers."""
    row, bit = np.nonzero((mask.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return covered(np.unique(first[row] + bit), window, n)


def without(joined: np.ndarray, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The words that are not gone, joined by one space."""
    sizes = np.diff(np.append(starts, len(joined) + 1))
    return np.append(joined, np.uint8(0x20))[np.repeat(~gone, sizes)].tobytes()[:-1]


def _rows(batch: pa.RecordBatch, texts: pa.Array):
    """Text (bytes), first and mask of the spans, one row after the other."""
    unzip = zstandard.ZstdDecompressor()
    spans = batch.column(1)
    ends = np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))
    flat = spans.flatten()
    first, mask = (np.asarray(flat.field(k)).astype(np.int64) for k in ("first", "mask"))
    at = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        yield None if not text.is_valid else unzip.decompress(text.as_buffer()), first[at:end], mask[at:end]
        at = end


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """The columns of docs as a struct, and the repeated windows of each row.

    Texts cross the shuffle compressed, as binary; only the side of the spans is hashed into memory.
    """
    spans = repeats(docs, window).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark_r"), F.col("spans").alias("_spans"))
    own, at = docs.columns, docs.columns.index("text")
    names, schema = ["_left", "_mark", "_row"], StructType([StructField("_left", LongType()), StructField("_mark", LongType()), StructField("_row", StructType([StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(docs.schema)]))])

    def squeeze(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            columns = batch.column(2).flatten()
            columns[at] = pa.array([None if x is None else zip_.compress(x.encode("utf-8", "surrogatepass")) for x in columns[at].to_pylist()], pa.binary())
            row = pa.StructArray.from_arrays(columns, names=own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), row], names=names)

    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("_left"), F.xxhash64("text").alias("_mark"), row).mapInArrow(lean(squeeze), schema)
    on = (F.col("_left") == F.col("_id")) & (F.col("_mark") == F.col("_mark_r"))
    return rows.join(spans.hint("shuffle_hash"), on, "left").select("_row", "_spans")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).flatten()
            for text, first, mask in _rows(batch, texts):
                joined, starts = tokens(text or b"")
                gone = removed_words(len(starts), first, mask, window) if len(first) else np.zeros(len(starts), bool)
                kept = without(joined, starts, gone) if gone.any() else joined.tobytes()
                rows.append((len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            n_words, n_removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, window).mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the covered words: a text that loses words becomes its kept words, joined by one space."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            columns = batch.column(0).flatten()
            kept = []
            for text, first, mask in _rows(batch, columns[at]):
                if len(first):
                    joined, starts = tokens(text)
                    text = without(joined, starts, removed_words(len(starts), first, mask, window))
                kept.append(text)
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_spans(docs, window).mapInArrow(lean(run), docs.schema)


def op5_super_kmers(spark, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS gram
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
b AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
x AS (
  SELECT DISTINCT r, i + o AS p FROM b, (SELECT unnest(range(0, 50)) AS o)),
k AS (
  SELECT r, list(p) AS gone FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
