import random

import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash as s

from .common import awkward, awkward_rows, empty, words


def brute_fingerprint(text):
    import re

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """Smallest id reachable from each row; links at 4 or fewer differing bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for i, k in enumerate(label):
        least.setdefault(k, []).append(ids[i])
    return [min((x for x in least[k] if x is not None), default=None) for k in label]


def clustered(n, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 150])):
            y = x
            for _ in range(rng.randrange(7)):
                y ^= 1 << rng.randrange(64)
            out.append(y)
    return out[:n]


@pytest.mark.parametrize("equal", [1, 2, 3])
def test_block_masks_find_every_pair(equal):
    masks = s.block_masks(4, equal)
    rng = random.Random(equal)
    for _ in range(500):
        flips = sum({1 << rng.randrange(64) for _ in range(4)})
        assert any(m & flips == 0 for m in masks)


def test_near_pairs_equal_brute_force():
    fps = np.array(clustered(700, 3), np.uint64)[:, None]
    runs = [(0, 1), (1, 63), (64, 64), (128, 65), (193, 507)]
    start, size = (np.array(x) for x in zip(*runs))
    got = {(int(a), int(b)) for i, j in s.near_pairs(fps, start, size, start, size) for a, b in zip(i, j)}
    want = {(i, j) for a, n in runs for i in range(a, a + n) for j in range(i + 1, a + n) if (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 4}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("radius", [7, 8, 60, 88, 127])
def test_wide_pairs_equal_brute_force(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(512) for _ in range(6)]
    near = []
    for _ in range(210):
        x = rng.choice(base)
        for _ in range(rng.randrange(radius + 20)):
            x ^= 1 << rng.randrange(512)
        near.append(x)
    fps = np.array([[x >> 64 * w & (1 << 64) - 1 for w in range(8)] for x in near], np.uint64)
    start, size = np.array([0, 100]), np.array([100, 110])
    got = {(int(a), int(b)) for i, j in s.near_pairs(fps, start, size, start, size, radius) for a, b in zip(i, j)}
    want = {(i, j) for a, n in zip(start.tolist(), size.tolist()) for i in range(a, a + n) for j in range(i + 1, a + n) if (near[i] ^ near[j]).bit_count() <= radius}
    assert got == want and want


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_are_grouped(spark):
    """Pairs of a similarity of 0.85 or more are found, those under 0.6 are left alone."""
    rng = random.Random(8)
    texts, bases = [], []
    for _ in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 400))]
        bases.append((base, edited(base, rng.randrange(1, 14), rng)))
        texts += bases[-1]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = {r.doc_id: r.root for r in s.similar_groups(docs).collect()}
    seen = {"near": [], "far": []}
    for n, (a, b) in enumerate(bases):
        j = jaccard(a, b)
        if j >= 0.85 or j < 0.6:
            seen["near" if j >= 0.85 else "far"].append(root[2 * n] == root[2 * n + 1])
    assert len(seen["near"]) > 30 and np.mean(seen["near"]) >= 0.97
    assert not any(seen["far"])
    assert len({root[2 * n] for n in range(120)}) == 120
    # chunked buckets give the same groups
    again = {r.doc_id: r.root for r in s.similar_groups(docs, chunk=5).collect()}
    assert {d: [e for e in root if root[e] == r] for d, r in root.items()} == {d: [e for e in again if again[e] == r] for d, r in again.items()}


def test_links_with_and_without_chunks(spark):
    fps = sorted(set(clustered(600, 5)))
    nodes = spark.createDataFrame([(s._signed(x),) for x in fps], "fp long")
    want = brute_components([s._signed(x) for x in fps], fps)
    from larkspur.llm.components import components

    for chunk in (s.CHUNK, 40):
        found = {r.u: r.v for r in components(s.links(nodes, chunk=chunk)).collect()}
        groups, expected = {}, {}
        for x, c in zip(fps, want):
            groups.setdefault(found.get(s._signed(x), s._signed(x)), set()).add(x)
            expected.setdefault(c, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_awkward_rows_equal_brute_force(spark):
    rows = awkward_rows()
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id or -1) for r in s.near_duplicates(awkward(spark, extra=True)).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    assert got == sorted((r[0] or -1, f, c or -1) for r, f, c in zip(rows, fps, comp))


def brute_groups(rows, similar):
    """A label for each row: the smallest row reachable by similar pairs."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and similar(i, j):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_keep_one(spark):
    docs = awkward(spark, extra=True)
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    rows = awkward_rows()
    lower = [[w.lower() for w in words(r[1])] for r in rows]
    label = brute_groups(rows, lambda i, j: jaccard(lower[i], lower[j]) >= 0.8)
    want = {}
    for r, k in zip(rows, label):
        want.setdefault(k, []).append(2**63 if r[0] is None else r[0])
    ids = sorted(2**63 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted(min(x) for x in want.values())


def test_empty(spark):
    assert s.near_duplicates(empty(spark)).count() == 0
    assert s.keep_one(empty(spark)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components([r.doc_id for r in rows], fps)
    got = sorted(map(tuple, s.op8_simhash(spark, sf_dir).collect()))
    assert got == sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))


def test_groups_are_those_of_exact_jaccard(spark):
    """Pairs about 0.8, some just over and some just under, group exactly as brute force says."""
    rng = random.Random(21)
    texts, pairs = [], []
    for i in range(150):
        base = [f"v{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 900))]
        other = list(base)
        for _ in range(max(1, round(len(base) * rng.uniform(0.015, 0.04)))):
            other[rng.randrange(len(other))] = f"n{rng.randrange(10**9)}"
        texts += [base, other]
        pairs.append(jaccard(base, other))
    assert sum(0.75 <= j < 0.8 for j in pairs) > 10 and sum(0.8 <= j < 0.85 for j in pairs) > 10
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = {r.doc_id: r.root for r in s.similar_groups(docs).collect()}
    assert [root[2 * i] == root[2 * i + 1] for i in range(150)] == [j >= 0.8 for j in pairs]


@pytest.mark.parametrize("common", [2, 20])
def test_groups_of_many_alike(spark, monkeypatch, common):
    """Versions of a few texts, with a preface that all share: brute force over all pairs, with common shingles last or not."""
    monkeypatch.setattr(s, "COMMON", common)
    rng = random.Random(4)
    preface, texts = [f"p{i}" for i in range(40)], []
    for b in range(5):
        now = preface + [f"b{b}w{i}" for i in range(150)]
        for _ in range(16):
            now = edited(now, rng.randrange(1, 6), rng)
            texts.append(now)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = {r.doc_id: r.root for r in s.similar_groups(docs, chunk=6).collect()}
    label = brute_groups(texts, lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(80) for j in range(i))
    assert 5 < len(set(label)) < 80


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 300, 700, 1100, 5000):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        for k in (0, 1, n // 4, n):
            other = np.unique(np.concatenate((h[k:], rng.integers(0, 2**63, n // 9).astype(np.uint64))))
            assert s.parities_apart(s.parity(h), s.parity(other)) <= len(np.setxor1d(h, other))


def test_folded_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 146, 600, 5000):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        for k in (0, 1, n // 5, n):
            other = np.unique(np.concatenate((h[k:], rng.integers(0, 2**63, k).astype(np.uint64))))
            x, y = (s.folded(s.parity(z)) for z in (h, other))
            assert len(x) == s.FOLD
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(h, other))


@pytest.mark.parametrize("chunk", [7, 16_384])
def test_copies_of_one_text_that_are_far_from_each_other(spark, chunk):
    """Many copies of a text, each about 0.8 from it and mostly less from each other: brute force over all pairs."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = [base] + [edited(base, rng.randrange(1, 9), rng) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = {r.doc_id: r.root for r in s.similar_groups(docs, chunk=chunk).collect()}
    label = brute_groups(texts, lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    n = len(texts)
    assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(n) for j in range(i))
    assert 10 < len(set(label)) < n - 10
