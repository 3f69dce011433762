import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing, sharding

from .common import awkward, awkward_rows, empty, words


def h(*parts):
    return int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16)


def check_shards(rows, got, n=16):
    want = Counter()
    for doc_id, text in rows:
        raw = (text or "").encode()
        scores = [h(doc_id, s) for s in range(n + 1)]
        shard = max(range(n), key=lambda s: (scores[s], -s))
        grown = max(range(n + 1), key=lambda s: (scores[s], -s))
        want[doc_id, len(raw) + 1, zlib.crc32(raw), "key", shard, grown] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, n)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards_equal_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_shards([tuple(r) for r in rows], sharding.op3_rendezvous_sharding(spark, sf_dir).collect())


def test_shards_of_awkward_rows(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check_shards(rows, sharding.shard_documents(awkward(spark, extra=True)).collect())
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)
    check_shards(rows, sharding.shard_documents(awkward(spark)).collect())


def test_weighted_shards_get_their_shares(spark):
    from pyspark.sql import functions as F

    ids = spark.range(8000).withColumnRenamed("id", "k")
    n = dict(sharding.assign(ids, "k", [1.0, 2.0, 5.0]).groupBy("shard").count().collect())
    assert [round(n[s] / 1000) for s in range(3)] == [1, 2, 5]
    with pytest.raises(ValueError):
        sharding.shard_scores(F.col("k"), [1.0, 0.0])


def test_empty_shards(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0


def brute_mix(rows):
    """taken of each row by water-filling and a walk down the keys."""
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[3]].append(i)
    names = sorted((x for x in by if x is not None), key=lambda x: [ord(c) for c in x]) + ([None] if None in by else [])
    size = {s: sum(len(words(rows[i][1])) for i in by[s]) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
        open_ -= set(over)
    out = {}
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        left = target[s] - epochs * size[s]

        def key(i):
            t = rows[i][1] or ""
            noise = sum(c in mixing.NOISE for c in t) / len(t) if t else None
            w = max(0.1, 1 - 4 * noise) if t else 0.1
            return (-math.log((h(rows[i][0]) + 0.5) / 2**52) / w, rows[i][0] if rows[i][0] is not None else -1, len(words(t)))

        ahead = 0
        for i in sorted(by[s], key=key):
            n = len(words(rows[i][1]))
            out[i] = (n, size[s], target[s], n * (epochs + (ahead + n * 0.5 <= left)))
            ahead += n
    return [out[i] for i in range(len(rows))]


def test_allocation_equals_brute_force(spark, monkeypatch):
    rows = awkward_rows()
    want = Counter((r[0], *(n, s, round(t, 6), k)) for r, (n, s, t, k) in zip(rows, brute_mix(rows)))
    for range_rows in (250, 1):
        monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
        got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.allocate(awkward(spark, extra=False)).collect())
        assert got == want


def test_targets_are_met(spark, sf_dir):
    got = mixing.op9_mixing(spark, sf_dir).collect()
    assert all(r.taken <= 2 * r["size"] for r in got)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        s = docs[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op9_mixing(spark, sf_dir).collect()))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = awkward(spark, extra=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken_rows = mixed.collect()
    assert all(words(r.text) for r in taken_rows)
    n = Counter(r.doc_id for r in taken_rows)
    want = Counter()
    for r, (size, _, _, taken) in zip(awkward_rows(), brute_mix(awkward_rows())):
        if size:
            want[r[0]] += taken // size
    assert n == +want


def test_empty_mix(spark):
    assert mixing.allocate(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("w", [0.1, 0.2, 0.5, 1.0])
def test_no_range_is_hot(spark, w):
    """Of the ranges that a source is cut into, none holds 2 % of its rows, whatever their weight."""
    u = (mixing.md5_unit52(F.col("id")).cast("double") + 0.5) / F.lit(float(2**52))
    share = 1.0 - F.exp(-F.log(u) / w * -mixing.LEAST_WEIGHT)
    counts = spark.range(40_000).groupBy(F.floor(share * mixing.MAX_RANGES)).count().collect()
    assert max(r["count"] for r in counts) < 0.02 * 40_000
