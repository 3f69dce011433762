"""Training-order materialisation of token sequences in fixed-stride shards.

Documents are tokenised (byte-level BPE, two bytes an id) and cut into
sequences of at most SEQUENCE ids, the last one ended by the end-of-text id.
A sequence's number comes from its document's id and its part.  A keyed
Feistel network, walked along its cycle until it falls below the size of the
numbers' domain, permutes the numbers.  Ranges of the permuted domain are the
shards; within a shard sequences stand in permuted order, a record of the same
size each.  Slots count the records of all shards in order, so they run from 0
without gaps, and slot k is at a known place in a known file: a run can be
resumed at any slot and reads on sequentially.

The documents are read twice, first only for the span of ids and the lengths,
and tokenised once; each record goes straight to its shard (one shuffle, by
shard).  The order depends on the ids, the texts' lengths and the key alone,
not on files, splits or executors.

The numbers are places among (span of ids + 1) x (most parts of a document), so
they have holes, and a slot is the rank of an image among those that exist.
Numbers without holes would need the number of ids of every document before
the first is placed: to tokenise twice, or to write all ids once more.  Numbers
are up to 96 bits wide, in two halves, so ids may lie as far apart as they can.

Record, little-endian: doc_id int64, part int32, ids int32 (negative if doc_id
is null), then SEQUENCE uint16 ids, padded with 0.  File: records only.

Defined results: a null or empty text is one sequence, the end-of-text id;
a run of white space of over RUN characters counts as several runs of RUN, and
decodes to the same text; rows with equal ids stand side by side, by their
records; an empty table writes no shard and gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import math
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialise, scratch, table
from .words import lean, ship

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How that vocabulary parts texts before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
SEQUENCE = 256
#: About so many records to a shard, at about so many bytes of text to an id.
SHARD = 16_384
BYTES_PER_ID = 2.5
KEY = 0x5EED_0F_0DE5
ROUNDS = 6
#: White space characters that are tokenised together; the pattern goes back over each of a run.
RUN = 100_000
_LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{%d}(?=\s\s)" % RUN)


class Tokenizer:
    """Encodes texts to arrays of uint16."""

    def __init__(self, folder: str = TOKENIZERS):
        import tiktoken

        with open(os.path.join(folder, VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._encoding = tiktoken.Encoding("bytes-50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= RUN:
            return np.array(self._encoding.encode_ordinary(text), np.uint16)
        edges = [0, *(m.end() for m in _LONG_RUN.finditer(text)), len(text)]
        return np.concatenate([np.array(self._encoding.encode_ordinary(text[a:b]), np.uint16) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def decode(self, ids) -> str:
        return self._encoding.decode([int(i) for i in ids])


def half_bits(n: int) -> int:
    """Bits of each half of a number below n, at most 64."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def halves(base: np.ndarray, parts: int, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of base * parts + part (base: uint64, parts < 2**31, part < 2**32), all below n."""
    half, low_32 = half_bits(n), np.uint64(0xFFFF_FFFF)
    base = base.astype(np.uint64)
    below = (base & low_32) * np.uint64(parts) + part.astype(np.uint64)
    above = (base >> np.uint64(32)) * np.uint64(parts) + (below >> np.uint64(32))  # of 2**32
    low, high = (above << np.uint64(32)) | (below & low_32), above >> np.uint64(32)
    left = high if half == 64 else (low >> np.uint64(half)) | (high << np.uint64(64 - half))
    return left, low & np.uint64((1 << half) - 1)


def feistel_halves(left: np.ndarray, right: np.ndarray, n: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """The images of numbers below n, as halves, under the keyed permutation of 0..n-1."""
    half = half_bits(n)
    mask = np.uint64((1 << half) - 1)
    last = np.uint64(n >> half), np.uint64(n & ((1 << half) - 1))
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1)) for r in range(1, ROUNDS + 1)]

    def once(left, right):
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left, right

    left, right = once(left, right)
    while (outside := (left > last[0]) | ((left == last[0]) & (right >= last[1]))).any():  # walk the cycle back into the domain
        left[outside], right[outside] = once(left[outside], right[outside])
    return left, right


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The images of x (0..n-1) under the keyed permutation of 0..n-1, for n up to 2**62."""
    left, right = feistel_halves(*halves(x, 1, np.zeros(len(x), np.uint64), n), n, key)
    return ((left << np.uint64(half_bits(n))) | right).astype(np.int64)


def record_type(sequence: int = SEQUENCE) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4"), ("ids", "<u2", (sequence,))])


def write_shards(docs: DataFrame, folder: str, key: int = KEY, sequence: int = SEQUENCE, shard: int = SHARD, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Write the shards below folder (URI); shard, first_slot, records, path of each."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = record_type(sequence)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    least, most, longest, total = source.agg(F.min("doc_id"), F.max("doc_id"), F.max(size), F.sum(size)).first()
    least, most, longest, total = least or 0, most or 0, longest or 0, total or 0
    parts = longest // sequence + 1  # an id stands for a byte at least, and one ends the text
    domain = (most - least + 2) * parts  # the last number of a document is that of null
    n_shards = max(1, math.ceil(total / BYTES_PER_ID / sequence / shard))
    scale, per = float(1 << half_bits(domain)), n_shards / domain

    def emit(batches):
        tokenizer = Tokenizer(tokenizers)
        for batch in batches:
            for some in range(0, batch.num_rows, 500):
                part = batch.slice(some, 500)
                records, base, nth = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(tokenizer.encode(text or ""), np.uint16(END))
                    k = -(-len(ids) // sequence)
                    r = np.zeros(k, kind)
                    r["doc_id"], r["part"] = doc_id or 0, np.arange(k)
                    r["n"] = np.minimum(sequence, len(ids) - sequence * np.arange(k)) * (-1 if doc_id is None else 1)
                    flat = np.zeros(k * sequence, np.uint16)
                    flat[: len(ids)] = ids
                    r["ids"] = flat.reshape(k, sequence)
                    records.append(r)
                    # null comes after the largest id, whose offset is as wide as a number can be
                    base.append(np.full(k, (most if doc_id is None else doc_id) - least, np.uint64))
                    nth.append(np.arange(k) + (parts if doc_id is None else 0))
                r = np.concatenate(records)
                yield placed(r, *feistel_halves(*halves(np.concatenate(base), parts, np.concatenate(nth), domain), domain, key))

    def placed(r, left, right):
        # what pads a record is left out on the way
        sizes = 16 + 2 * np.abs(r["n"]).astype(np.int64)
        raw = r.view(np.uint8).reshape(len(r), kind.itemsize)
        body = raw[np.arange(kind.itemsize)[None, :] < sizes[:, None]]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())])
        shard = np.minimum(n_shards - 1, (left.astype(float) * scale + right.astype(float)) * per)  # never falls as the image rises
        columns = [pa.array(shard.astype(np.int32)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), rows]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "left", "right", "record"])

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        current, out, path, n = None, None, "", 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int32()), "records": pa.array([n], pa.int64()), "path": [path]})

        for batch in batches:
            for s, record in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != current:
                    if out is not None:
                        yield closed()
                    current, n, path = s, 0, f"{folder}/shard-{s:06d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(filesystem(path)[1], compression=None)
                out.write(record.ljust(kind.itemsize, b"\0"))
                n += 1
        if out is not None:
            yield closed()

    tasks = min(n_shards, 20_000)
    dealt = source.mapInArrow(lean(emit), "shard int, left long, right long, record binary").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "left", "right", "record")
    written = materialise(dealt.mapInArrow(lean(write), "shard int, records long, path string"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return written.select("shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first_slot"), "records", "path")


def read_from(path: str, place: int = 0, sequence: int = SEQUENCE, most: int = 4096):
    """Records of a shard from a place on, in arrays of up to `most`: one seek, then sequential."""
    kind = record_type(sequence)
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        f.seek(place * kind.itemsize)
        while data := f.read(most * kind.itemsize):
            yield np.frombuffer(data, kind)


def read_shards(spark: SparkSession, shards: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """slot, shard, doc_id, part, n_tokens, tokens_crc32 of every record, read back in the order of slots within each shard."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for shard, first, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in read_from(path, 0, sequence):
                    held = np.abs(r["n"])
                    crc = [zlib.crc32(row[:n].tobytes()) for row, n in zip(r["ids"], held.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(first, first + len(r))),
                            pa.array(np.full(len(r), shard, np.int32)),
                            pa.array(r["doc_id"].copy(), mask=r["n"] < 0),
                            pa.array(r["part"].copy()),
                            pa.array(held),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["slot", "shard", "doc_id", "part", "n_tokens", "tokens_crc32"],
                    )
                    first += len(r)

    n = max(1, shards.count())
    return shards.select("shard", "first_slot", "path").repartition(n).mapInArrow(lean(run), "slot long, shard int, doc_id long, part int, n_tokens int, tokens_crc32 long")


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
