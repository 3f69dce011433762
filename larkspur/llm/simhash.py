"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: majority votes of the hashes of word shingles, bit by bit.
Equal fingerprints are one node.  Two nodes link if few enough bits differ.

Comparison: within a bucket, up to 64 fingerprints lie as vertical bit planes,
a lane each.  A query flips each plane by its own bit; eight planes at a time
go through carry-save adders into bitwise counters, which count the differing
bits of 64 lanes at once.  Every few planes, blocks of which no lane is within
the radius any more are abandoned.  Whole partitions of buckets are compared
as arrays.  A bucket passes on a star of links to a linked node, never all
pairs.  Buckets of more than CHUNK nodes are cut into chunks, and each pair of
chunks is a task of its own.

Buckets (64 bits, radius RADIUS, XXH64 with seed 42): the bits are cut into
RADIUS + EQUAL blocks.  At most RADIUS of them can differ, so a linked pair
agrees on some EQUAL blocks: there is a table for each choice of them, the same
ones at every number of nodes.

`similar_groups` is the same comparison of fingerprints over five-word
shingles, followed by an exact check: a link stands only if the Jaccard
similarity of the two sets of shingles (as 64-bit hashes) is high enough.  So
few bits find the closest copies alone, so an exact way for the rest goes on
from there: prefixes.  In an order that all sets share, two similar sets have
one of their first shingles in common, about a fifth of them at 0.8.  Sizes,
places in the prefix and parities drop only pairs that cannot be similar (those
of large groups before they leave their bucket), and each pair left is decided
by its sets, so no link is lost and none is made
below the similarity.  Links of fingerprints and neighbours in buckets are
decided first; then only pairs that these links leave apart.

Defined results: null and wordless texts have fingerprint 0 and link like any
other; a null doc_id is larger than all others, and the component of a group
without any doc_id is null; repeated rows are equal nodes; empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components
from .words import lean, mixed, ship

SEED = 42
SHINGLE = 4
RADIUS = 4
CHUNK = 4096
#: Blocks that a linked pair has in common in one table or another.
EQUAL = 2
#: (query, block of 64 lanes) elements compared at once.
SLAB = 1 << 18
#: Planes between two looks at which blocks can be abandoned, for small and for large radii.
STRIDE, WIDE_STRIDE = 8, 64
#: Near-duplicates by similarity: words to a shingle, and the similarity.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
WIDE_CHUNK = 16_384
#: Fewest bits of a set's parity, and the most marks of candidates that are broadcast; beyond, texts are shuffled.
LEAST_PARITY, FEW_MARKS = 512, 2_000_000
#: Longs of a parity of the fewest bits.
FOLD = LEAST_PARITY // 64
#: Documents in which common shingles are sought (about so many), in how many of them, and the most kept.
SAMPLE, COMMON, MOST_COMMON = 20_000, 20, 100_000
#: Rows of sorted buckets that a task compares together.
ROWS_AT_ONCE = 16_384


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `shingle` lower-case words, joined by a space; of all words, if there are fewer."""
    words = split_lower(text)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n - shingle + 1)


def votes(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(h):
        return 0
    count = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return votes(shingle_hashes(text, shingle, seed))


def split_lower(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes.lower() changes no other byte."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp: a hash of the text, and the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(lean(run), f"doc_id {kind}, mark long, fp long")


def block_masks(radius: int, equal: int) -> list[int]:
    """A mask of bits for each choice of `equal` out of radius + equal blocks."""
    n = radius + equal
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum bit and the carry bit of three bits, in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def linked_lanes(queries: np.ndarray, blocks: np.ndarray, planes: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements (query, block) that have a lane within the radius, and those lanes.

    queries: n x words of 64 bits; blocks: the block of each; planes: bits x number of blocks; lanes: those to compare, as bits.
    """
    at = np.flatnonzero(lanes)
    q, b, alive = queries[at], blocks[at], lanes[at]
    counter = [np.zeros(len(at), np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros(len(at), np.uint64)
    stride = STRIDE if radius < 8 else WIDE_STRIDE
    for first in range(0, len(planes), 8):
        d = [planes[bit][b] ^ (np.uint64(0) - ((q[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1))) for bit in range(first, first + 8)]
        ones, twos, fours = counter[:3]
        ones, t1 = _csa(ones, d[0], d[1])
        ones, t2 = _csa(ones, d[2], d[3])
        twos, f1 = _csa(twos, t1, t2)
        ones, t1 = _csa(ones, d[4], d[5])
        ones, t2 = _csa(ones, d[6], d[7])
        twos, f2 = _csa(twos, t1, t2)
        fours, carry = _csa(fours, f1, f2)
        counter[:3] = ones, twos, fours
        for k in range(3, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if (first + 8) % stride == 0 or first + 8 == len(planes):
            near = alive & ~over & _at_most(counter, radius)
            keep = near != 0
            if keep.all():
                alive = near
            else:
                at, q, b, over, alive = (x[keep] for x in (at, q, b, over, near))
                counter = [x[keep] for x in counter]
            if not len(at):
                break
    return at, alive


def _at_most(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is at most the radius, compared from the top bit down."""
    above, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            above |= same & counter[k]
            same = same & ~counter[k]
    return ~above


def _planes(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertical bit planes of runs of fps (n x words), each run padded to whole blocks of 64 lanes.

    Returns planes (bits x blocks), the row in lane 0 of each block, its number of lanes, and the first block of each run.
    """
    per = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(per)))
    total = int(first[-1])
    run = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(total) - first[run]
    row = starts[run] + 64 * nth
    used = np.minimum(64, sizes[run] - 64 * nth)
    lane = np.arange(64)
    index = row[:, None] + np.minimum(lane[None, :], used[:, None] - 1)
    out = []
    for w in range(fps.shape[1]):
        bits = np.unpackbits(fps[:, w][index].astype("<u8").view(np.uint8).reshape(total, 64, 8), axis=2, bitorder="little")  # block, lane, bit
        out.append(np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, total))
    return np.concatenate(out), row, used, first[:-1]


def near_pairs(fps: np.ndarray, q_start: np.ndarray, q_size: np.ndarray, c_start: np.ndarray, c_size: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j) of rows of fps (n x words) within the radius: queries of a run against the candidates of the same run.

    Where a run's queries are its candidates, only i < j is compared.
    """
    if not len(q_size):
        return
    planes, row, used, first = _planes(fps, c_start, c_size)
    per = -(-c_size // 64)
    same = q_start == c_start
    run = 0
    while run < len(q_size):
        # whole runs up to a slab, or one run's queries in parts
        work = np.cumsum((q_size[run:] * per[run:]))
        take = max(1, int(np.searchsorted(work, SLAB, "right")))
        runs = np.arange(run, run + take)
        part = max(1, SLAB // max(1, int(per[run]))) if take == 1 else None
        for lo in range(0, int(q_size[run]) if part else 1, part or 1):
            qs = q_start[runs] + lo
            qn = np.minimum(part, q_size[runs] - lo) if part else q_size[runs]
            q_run = np.repeat(np.arange(len(runs)), qn)
            q_row = qs[q_run] + (np.arange(len(q_run)) - np.repeat(np.cumsum(qn) - qn, qn))
            wide = per[runs][q_run]
            e_query = np.repeat(q_row, wide)
            e_run = np.repeat(q_run, wide)
            e_block = first[runs][e_run] + (np.arange(len(e_query)) - np.repeat(np.cumsum(wide) - wide, wide))
            lanes = _low_bits(used[e_block])
            tri = same[runs][e_run]
            skip = np.clip(e_query - row[e_block] + 1, 0, 64)
            lanes = np.where(tri, lanes & ~_low_bits(skip), lanes)
            at, alive = linked_lanes(fps[e_query], e_block, planes, lanes, radius)
            if len(at):
                hit = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                e, lane = np.nonzero(hit)
                yield e_query[at[e]], row[e_block[at[e]]] + lane
        run += take


def _low_bits(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64)
    return np.where(n >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def local_stars(n: int, pairs) -> np.ndarray:
    """The smallest row of each row's component, under the links in pairs (an iterable of index arrays)."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _compare_groups(batches, radius: int):
    """Sorted rows (t, k, a, b, part, id, fp) -> stars (u, v) of ids, many groups at once; the last group is kept back until it ends."""
    parts: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([*(np.asarray(c) for c in batch.columns[:-1]), _words(batch.column(batch.num_columns - 1))])
        rows += batch.num_rows
        if rows < ROWS_AT_ONCE:
            continue
        now = [np.concatenate(x) for x in zip(*parts, strict=True)]
        same = np.ones(rows, bool)
        for c in now[:4]:
            same &= c == c[-1]
        start = rows - int(same[::-1].argmin()) if not same.all() else 0
        parts, rows = [[c[start:] for c in now]], rows - start
        if start:
            yield from _stars([c[:start] for c in now], radius)
    if parts:
        yield from _stars([np.concatenate(x) for x in zip(*parts, strict=True)], radius)


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints as n x words: longs, or binary of whole words."""
    if pa.types.is_integer(column.type):
        return np.asarray(column).view(np.uint64)[:, None]
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u8").reshape(len(column), -1)


def _stars(columns: list[np.ndarray], radius: int):
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns[:4]:
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, n))
    part, ids, fps = columns[4:]
    second = np.add.reduceat(part, start)  # rows of part 1 stand last in their group
    q_size = size - second
    c_start = np.where(second > 0, start + q_size, start)
    c_size = np.where(second > 0, second, size)
    keep = (size > 1) & (q_size > 0)
    label = local_stars(n, near_pairs(fps, start[keep], q_size[keep], c_start[keep], c_size[keep], radius))
    moved = np.flatnonzero(label != np.arange(n))
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])


def _star_links(keyed: DataFrame, radius: int, chunk: int) -> DataFrame:
    """keyed (t, k, id, fp) -> (u, v): links whose components are those of all pairs of a bucket within the radius."""
    large = materialise(keyed.groupBy("t", "k").count().filter(F.col("count") > chunk).select("t", "k", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "large-buckets")
    if large.head(1) != []:
        keyed = keyed.join(large, ["t", "k"], "left")
        mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keyed = (
            keyed.withColumn("mine", F.when(F.col("chunks").isNull(), 0).otherwise(mine))
            .withColumn("other", other)
            .select("t", "k", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("long").alias("part"), "id", "fp")
        )
    else:
        keyed = keyed.select("t", "k", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("part"), "id", "fp")
    ordered = keyed.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", "part")
    return ordered.mapInArrow(lean(lambda batches: _compare_groups(batches, radius)), "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, equal: int = EQUAL) -> DataFrame:
    """nodes (fp, distinct longs) -> (u, v): links whose components are those of all pairs within the radius."""
    ship(nodes.sparkSession)
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(block_masks(radius, equal))])).alias("x"),
    ).select("x.t", "x.k", F.col("fp").alias("id"), "fp")
    return _star_links(keyed, radius, chunk)


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in rising order."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def share(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction of integers, so that no comparison rounds."""
    return Fraction(str(similarity)).as_integer_ratio()


def prefix_length(n: int, similarity: float) -> int:
    """So many first shingles of a set of n, in any order that all sets share: similar sets have one of them in common."""
    num, den = share(similarity)
    return n - -(-num * n // den) + 1 if n else 0


def parity(h: np.ndarray) -> bytes:
    """Bits that each shingle flips one of: two sets differ by at least as many shingles as their parities do by bits.

    A power of two of bits, no fewer than shingles.
    """
    bits = max(LEAST_PARITY, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((mixed(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parities_apart(x: bytes, y: bytes) -> int:
    """Bits by which two parities differ, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(z, np.uint8) for z in ((x, y) if len(x) <= len(y) else (y, x)))
    return int.from_bytes((x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).tobytes(), "little").bit_count()


def folded(x: bytes) -> np.ndarray:
    """A parity folded to LEAST_PARITY bits, as longs: these too differ by no more bits than the sets by shingles."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, FOLD), axis=0)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many documents of a sample by the hash of the text, in rising order; they come last in prefixes, which changes the cost alone."""
    n = docs.count()
    few = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < (SAMPLE << 40) // max(n, SAMPLE))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x) for x in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    counts = few.mapInArrow(lean(run), "s long").groupBy("s").count().filter(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "s").limit(MOST_COMMON).collect()
    return np.sort(np.array([r.s for r in rows], np.int64).view(np.uint64))


def _shingled(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, mark, id (of the shingle set), fp, n (its size), its parity, the folded one, and its prefix."""
    ship(docs.sparkSession)
    common = common_shingles(docs)

    def run(batches):
        for batch in batches:
            ids, fps, sizes, parities, prefixes = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingle_hashes(text, WIDE_SHINGLE, SEED)
                fps.append(votes(h))
                h = np.unique(h)
                ids.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                parities.append(parity(h))
                if len(common) and len(h):
                    last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    h = np.concatenate((h[~last], h[last]))
                prefixes.append(h[: prefix_length(len(h), similarity)].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([folded(x) for x in parities], prefixes)]
            columns = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "mark", "id", "fp", "n", "parity", "fold", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(lean(run), f"doc_id {kind}, mark long, id long, fp long, n long, parity binary, fold array<long>, prefix array<long>")


def _runs_of_buckets(batches, keys: int):
    """Whole buckets (rows equal in the first `keys` columns) of sorted batches, many at once, as lists of columns."""
    parts: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([np.asarray(c) for c in batch.columns])
        rows += batch.num_rows
        if rows < ROWS_AT_ONCE:
            continue
        now = [np.concatenate(x) for x in zip(*parts, strict=True)]
        other = np.zeros(rows, bool)
        for c in now[:keys]:
            other |= c != c[-1]
        start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        parts, rows = [[c[start:] for c in now]], rows - start
        if start:
            yield [c[:start] for c in now]
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _bucket_pairs(columns: list[np.ndarray], similarity: float, chained: bool):
    """Sorted rows (s, a, b, n, id, at, mine, root, then a folded parity's longs or none) -> batches of pairs of ids that may be similar: neighbours if chained, else all of different roots."""
    s, a, b, n, ids, at, mine, root, *parts = columns
    num, den = share(similarity)
    live = np.arange(len(s))
    step = 0
    while True:
        step += 1
        live = live[live + step < len(s)]
        j = live + step
        # rows of a bucket rise by n: once sizes are too far apart, they stay so
        live = live[(s[live] == s[j]) & (a[live] == a[j]) & (b[live] == b[j]) & (den * n[live] >= num * n[j])]
        if not len(live):
            return
        j = live + step
        # the first shingle that two sets share has at most the shorter rest of shingles after it in common
        most = 1 + np.minimum(n[live] - at[live], n[j] - at[j]) - 1
        take = (most * (num + den) >= num * (n[live] + n[j])) & ((a[live] == b[live]) | (mine[live] != mine[j])) & (root[live] != root[j])
        i, k = live[take], j[take]
        if parts and len(i):
            apart = sum(np.bitwise_count(x[i] ^ x[k]).astype(np.int64) for x in (p.view(np.uint64) for p in parts))
            near = apart * (num + den) <= (den - num) * (n[i] + n[k])
            i, k = i[near], k[near]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[k])), pa.array(np.maximum(ids[i], ids[k]))], names=["u", "v"])
        if chained:
            return


def _candidates(rows: DataFrame, similarity: float, chained: bool, chunk: int) -> DataFrame:
    """rows (s, id, n, at, root and, if given, fold) -> distinct (u, v)."""
    large = materialise(rows.groupBy("s").count().filter(F.col("count") > chunk).select("s", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "large-buckets")
    if not chained and large.head(1) != []:
        rows = rows.join(large, "s", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        rows = rows.withColumn("mine", F.lit(0)).withColumn("other", F.lit(0))
    keyed = rows.select("s", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "n", "id", "at", "mine", "root", *([F.col("fold")[i].alias(f"fold_{i}") for i in range(FOLD)] if "fold" in rows.columns else []))

    def run(batches):
        for columns in _runs_of_buckets(batches, 3):
            yield from _bucket_pairs(columns, similarity, chained)

    found = keyed.repartition("s", "a", "b").sortWithinPartitions("s", "a", "b", "n", "id").mapInArrow(lean(run), "u long, v long")
    return found.distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v), those whose shingle sets have that Jaccard similarity: by parity first, which drops none of them, then by the sets."""
    num, den = share(similarity)
    nodes = nodes.select("id", "mark", "n", "parity")
    one = nodes.select(F.col("id").alias("u"), F.col("mark").alias("u_mark"), F.col("n").alias("u_n"), F.col("parity").alias("u_parity"))
    two = nodes.select(F.col("id").alias("v"), F.col("mark").alias("v_mark"), F.col("n").alias("v_n"), F.col("parity").alias("v_parity"))

    def sift(batches):
        for batch in batches:
            apart = np.array([parities_apart(x, y) for x, y in zip(batch.column("u_parity").to_pylist(), batch.column("v_parity").to_pylist(), strict=True)], np.int64)
            both = np.asarray(batch.column("u_n")) + np.asarray(batch.column("v_n"))
            yield batch.select(["u", "v", "u_mark", "v_mark"]).filter(pa.array(apart * (num + den) <= (den - num) * both))

    left = materialise(pairs.join(one, "u").join(two, "v").mapInArrow(lean(sift), "u long, v long, u_mark long, v_mark long"), "sifted-pairs")
    marks = materialise(left.select(F.col("u_mark").alias("mark")).union(left.select("v_mark")).distinct(), "candidate-marks")
    marks = F.broadcast(marks) if marks.count() <= FEW_MARKS else marks
    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(marks, "mark", "left_semi").dropDuplicates(["mark"])

    def sets(batches):
        for batch in batches:
            found = [shingle_set(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["mark", "shingles"])

    known = materialise(texts.mapInArrow(lean(sets), "mark long, shingles binary"), "candidate-shingles")
    one = known.select(F.col("mark").alias("u_mark"), F.col("shingles").alias("u_set"))
    two = known.select(F.col("mark").alias("v_mark"), F.col("shingles").alias("v_set"))

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("u_set"), batch.column("v_set"), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return left.join(one, "u_mark").join(two, "v_mark").mapInArrow(lean(judge), "u long, v long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, chunk: int = WIDE_CHUNK) -> DataFrame:
    """doc_id, mark and root (that names the group) of each row: groups of documents linked by that Jaccard similarity of their shingles, exactly."""
    marked = materialise(_shingled(docs, similarity), "shingled")
    nodes = materialise(marked.groupBy("id").agg(F.min_by(F.struct("mark", "fp", "n", "parity", "fold", "prefix"), "mark").alias("x")).select("id", "x.*"), "shingle-sets")
    rows = nodes.select("id", "n", F.posexplode("prefix").alias("at", "s"))
    rows = rows.withColumn("of", F.count("*").over(Window.partitionBy("s"))).filter("of > 1").drop("of")
    rows = materialise(rows, "shared-shingles")
    # links of fingerprints, and neighbours: what they link need not be compared again
    first = _near_sets(nodes).union(_candidates(rows.withColumn("root", F.col("id")), similarity, True, chunk)).distinct()
    chains = materialise(_verified(first, nodes, docs, similarity), "chains")
    roots = components(chains)
    # pairs that these links leave apart: a group's pairs are many, so folded parities go along and drop those that are surely not similar where they meet
    known = nodes.select("id", "fold").join(roots, F.col("id") == F.col("u"), "left").select("id", "fold", F.coalesce("v", "id").alias("root"))
    rooted = rows.join(known, "id").select("s", "id", "n", "at", "root", "fold")
    rest = _verified(_candidates(rooted, similarity, False, chunk), nodes, docs, similarity)
    stars = materialise(components(chains.unionByName(rest)), "wide-stars")
    return marked.join(stars, marked["id"] == stars["u"], "left").select("doc_id", "mark", F.coalesce("v", "id").alias("root"))


def _near_sets(nodes: DataFrame) -> DataFrame:
    """nodes (id, fp) -> (u, v): of nodes with one fingerprint, each with the smallest; of linked fingerprints, the smallest of both."""
    least = materialise(nodes.groupBy("fp").agg(F.min("id").alias("least")), "set-fingerprints")
    same = nodes.select("id", "fp").join(least, "fp").filter("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    one = least.select(F.col("fp").alias("u"), F.col("least").alias("i"))
    two = least.select(F.col("fp").alias("v"), F.col("least").alias("j"))
    near = links(least.select("fp")).join(one, "u").join(two, "v").select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
    return same.union(near)


def marked_components(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, root (a fingerprint that names the component) and component_id of each row."""
    marked = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    stars = components(links(nodes.select("fp")))
    rooted = nodes.join(stars, nodes["fp"] == stars["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "components-of")
    return marked.join(of, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to."""
    return marked_components(docs).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of similar ones, that with the smallest doc_id, with the columns of docs.

    Of several rows with that doc_id, the one with the smallest hash of its text
    stays; of rows alike in both, that with the smallest hash of all columns.
    All null and wordless documents are one group.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    first = F.min(F.struct(key.alias("_key"), F.col("mark").alias("_mark")))
    keep = materialise(similar_groups(docs, similarity).groupBy("root").agg(first.alias("x")).select("x.*"), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(key.alias("_key"), F.xxhash64("text").alias("_mark"), row.alias("_row")).groupBy("_key", "_mark").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return rows.join(keep, ["_key", "_mark"], "left_semi").select("_row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
