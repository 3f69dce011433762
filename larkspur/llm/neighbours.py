"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks.  A tile is a group of query blocks against a
group of candidate blocks.  In a tile, vectors are scaled to int8; one matrix
product of the integers gives an approximate inner product of every pair, and
the norms of what rounding left over bound its error.  Pairs whose upper bound
reaches the running k-th best are computed again in double precision, in the
order of the components, and kept in a heap of k per query.  Tiles' heaps are
merged at the end, so what moves is k rows per query and tile.

The bound never drops a true neighbour: the result is exact.  The integers are
multiplied as float32, whose 24 bits hold the sums exactly up to SLICE
components; longer vectors are multiplied in slices, whose sums are added as
float64.

Equal rows are counted before anything moves, and one vector under many ids is
held in a block with its k + 1 smallest ids: no query can use more of them.  A
row's tile comes from its vec_id alone, so a task that runs again deals alike.

Every block of queries meets every block of candidates, so the work is the
product of the two numbers of vectors, and copies of blocks move once for each
tile: 5 x 10**7 queries against 10**9 candidates of 64 components would be 3 x
10**18 multiplications, and each candidate would move 5 x 10**4 times at tiles
of TILE_QUERIES; larger tiles move less and take more memory.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part, nor do null ids; vectors of other lengths
than the query's aren't its candidates, nor are rows with its own vec_id;
repeated candidate rows count each; equal rows among the queries are one
query; ties go to the smaller vec_id; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .words import lean, ship

K = 20
QUERY_EVERY = 20
#: Queries and candidates to a tile, and vectors to a block.
TILE_QUERIES, TILE_CANDIDATES, BLOCK = 1024, 16_384, 2048
LEVELS = 127
SLICE = (1 << 24) // LEVELS**2

VALID = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"

_HEAD = struct.Struct("<qq")


def _pack(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    return _HEAD.pack(*vectors.shape) + ids.astype("<i8").tobytes() + vectors.astype("<f8").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dims = _HEAD.unpack_from(blob)
    return np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, "<f8", n * dims, 16 + 8 * n).reshape(n, dims)


def _few_of_each(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows in the order of ids, without those that repeat a vector already held `most` times."""
    seen: dict[bytes, int] = {}
    keep = []
    for i in np.argsort(ids, kind="stable").tolist():
        key = xxhash.xxh3_128_digest(vectors[i].tobytes())
        seen[key] = n = seen.get(key, 0) + 1
        if n <= most:
            keep.append(i)
    return np.array(keep, np.int64)


def blocks(vectors: DataFrame, groups: int, k: int, most: int | None = None) -> DataFrame:
    """vec_id, embedding (double), times -> own, blob: up to BLOCK vectors of one length each, of one of the groups."""

    def run(batches):
        held: dict[int, list] = {}
        current = None

        def block(rows):
            ids, data, times = np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]), np.array([r[2] for r in rows])
            if most is not None:
                keep = _few_of_each(ids, data, most)
                ids, data, times = ids[keep], data[keep], times[keep]
            times = np.minimum(times, k)  # no query has room for more
            return pa.RecordBatch.from_pydict({"own": pa.array([current], pa.int64()), "blob": pa.array([_pack(np.repeat(ids, times), np.repeat(data, times, axis=0))], pa.binary())})

        for batch in batches:
            owns, ids, column, times = (batch.column(i) for i in range(4))
            values, offsets = np.asarray(column.values), np.asarray(column.offsets)
            for i, (own, vec_id, n) in enumerate(zip(owns.to_pylist(), ids.to_pylist(), times.to_pylist(), strict=True)):
                if own != current:
                    for rows in held.values():
                        yield block(rows)
                    held, current = {}, own
                v = values[offsets[i] : offsets[i + 1]].copy()
                rows = held.setdefault(len(v), [])
                rows.append((vec_id, v, n))
                if len(rows) == BLOCK:
                    yield block(held.pop(len(v)))
        for rows in held.values():
            yield block(rows)

    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("own"), "vec_id", "embedding", "times").repartition(min(groups, 20_000), "own").sortWithinPartitions("own", "vec_id")
    return dealt.mapInArrow(lean(run), "own long, blob binary")


class Quantised:
    """Vectors as int8 levels times a scale, with the norms that bound the error."""

    def __init__(self, vectors: np.ndarray):
        scale = np.abs(vectors).max(axis=1) / LEVELS
        with np.errstate(divide="ignore", invalid="ignore"):  # subnormal scales round to 0
            levels = np.where(scale[:, None] > 0, np.rint(vectors / scale[:, None]), 0.0)
        self.levels, self.scale = levels.astype(np.int8), scale
        rounded = levels * scale[:, None]
        self.left = np.sqrt(((vectors - rounded) ** 2).sum(axis=1))
        self.norm = np.sqrt((rounded**2).sum(axis=1))

    def bounds(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Approximate products with each vector of other, and the most by which they can be off."""
        sums = np.zeros((len(self.levels), len(other.levels)))
        for a in range(0, self.levels.shape[1], SLICE):
            sums += self.levels[:, a : a + SLICE].astype(np.float32) @ other.levels[:, a : a + SLICE].astype(np.float32).T
        near = sums * self.scale[:, None] * other.scale[None, :]
        full = other.norm + other.left
        off = self.left[:, None] * full[None, :] + self.norm[:, None] * other.left[None, :]
        slack = 1e-12 * (self.norm + self.left)[:, None] * full[None, :]
        return near, off + slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Heaps:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.quantised = Quantised(vectors)
        self.query = np.empty(0, np.int64)
        self.found = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.least = np.full(len(ids), -np.inf)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        near, off = self.quantised.bounds(Quantised(vectors))
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - off)
        enough = self.least
        if low.shape[1] >= self.k:
            enough = np.maximum(enough, np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k])
        q, c = np.nonzero((near + off >= enough[:, None]) & ~own)
        for a in range(0, len(q), 1 << 18):
            self._merge(q[a : a + (1 << 18)], c[a : a + (1 << 18)], ids, vectors)

    def _merge(self, q, c, ids, vectors) -> None:
        score = exact(self.vectors[q], vectors[c])
        query, found, score = np.concatenate((self.query, q)), np.concatenate((self.found, ids[c])), np.concatenate((self.score, score))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        begin = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - begin[query]
        keep = rank < self.k
        self.query, self.found, self.score = query[keep], found[keep], score[keep]
        last = rank == self.k - 1
        self.least[query[last]] = score[last]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product of each query."""
    spark = vectors.sparkSession
    ship(spark)
    shape = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    all_ = vectors.select(*shape).filter(VALID).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    asked = queries.select(*shape).filter(VALID).distinct().withColumn("times", F.lit(1).cast("long"))
    n, n_asked = all_.count(), asked.count()
    rows, columns = max(1, math.ceil(n_asked / TILE_QUERIES)), max(1, math.ceil(n / TILE_CANDIDATES))
    q, c = blocks(asked, rows, k), blocks(all_, columns, k, k + 1)
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("other"), "own", "blob").select((F.col("own") * columns + F.col("other")).alias("tile"), F.lit(0).alias("kind"), "blob")
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("other"), "own", "blob").select((F.col("other") * columns + F.col("own")).alias("tile"), F.lit(1).alias("kind"), "blob")

    def run(batches):
        current, heaps = None, []

        def done():
            for h in heaps:
                if len(h.query):
                    yield pa.RecordBatch.from_arrays([pa.array(h.ids[h.query]), pa.array([xxhash.xxh3_64_intdigest(h.vectors[i].tobytes()) >> 1 for i in h.query.tolist()], pa.int64()), pa.array(h.found), pa.array(h.score)], names=["query_id", "of", "vec_id", "score"])

        for batch in batches:
            for tile, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if tile != current:
                    yield from done()
                    current, heaps = tile, []
                ids, data = _unpack(blob.as_py())
                if kind == 0:
                    same = [i for i, h in enumerate(heaps) if h.vectors.shape[1] == data.shape[1]]
                    if same:  # no candidate was offered yet
                        h = heaps.pop(same[0])
                        ids, data = np.concatenate((h.ids, ids)), np.concatenate((h.vectors, data))
                    heaps.append(Heaps(ids, data, k))
                else:
                    for h in heaps:
                        if h.vectors.shape[1] == data.shape[1]:
                            h.offer(ids, data)
        yield from done()

    tiles = min(rows * columns, 20_000)
    dealt = q.unionByName(c).repartitionById(tiles, F.pmod("tile", F.lit(tiles)).cast("int")).sortWithinPartitions("tile", "kind")
    best = Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), "vec_id")
    return (
        dealt.mapInArrow(lean(run), "query_id long, of long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_block_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
