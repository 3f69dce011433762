import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import substrings as s

from .common import awkward, awkward_rows, empty, words


def brute(rows, window=50):
    """(doc_id, n_words, n_removed, kept text) by a dictionary of all windows."""
    least = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept))
    return out


def digest(rows):
    return sorted(((d if d is not None else -1), n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in rows)


def got(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [" ".join(f"p{k}w{rng.randrange(40)}" for _ in range(rng.randrange(45, 140))) for k in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.4 else " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.randrange(5, 90))))
        rows.append((rng.randrange(n * 2), "  ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed, monkeypatch):
    rows = list({d: (d, t) for d, t in passages(seed)}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if seed == 2:  # every repeated run is hot, there are many buckets, and windows are sorted in passes
        monkeypatch.setattr(s, "HOT_SHARE", 1e-9)
        monkeypatch.setattr(s, "BUCKET_WINDOWS", 100)
        monkeypatch.setattr(s, "PASS_WINDOWS", 30)
        assert s.survey(docs)[1]
    want = digest(brute(rows))
    assert got(s.removal_digest(docs)) == want
    assert sum(x[2] for x in want) > 1000


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got(s.removal_digest(awkward(spark, extra=True))) == digest(brute(rows))


def test_remove_repeats_keeps_columns(spark):
    docs = awkward(spark, extra=True)
    out = s.remove_repeats(docs)
    assert out.columns == docs.columns
    want = {}
    for d, n, gone, kept in brute([(r[0], r[1]) for r in awkward_rows()]):
        want.setdefault(d, []).append(kept if gone else None)
    texts = {}
    for r in awkward_rows():
        texts.setdefault(r[0], []).append(r[1])
    for r in out.collect():
        assert r.text in [k if k is not None else t for k, t in zip(want[r.doc_id], texts[r.doc_id])]


def test_empty(spark):
    assert s.removal_digest(empty(spark)).count() == 0


def test_long_runs_are_cut():
    h = np.full(5000, 7, np.uint64)
    route, first, size = s.super_kmers(h)
    assert size.max() == s.MOST_WINDOWS and size.sum() == 4951 and (np.diff(first) == size[:-1]).all()


def test_strays_of_equal_hashes_go_by_their_words(monkeypatch):
    """With a hash that is always equal, windows still count by their words."""
    monkeypatch.setattr(s, "windows", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    a, b = " ".join(f"a{i}" for i in range(52)).encode(), " ".join(f"a{i}" for i in range(1, 51)).encode()
    out = {string: least.tolist() for _, string, least in s._shared_minima([(1, a, 5, 5), (1, b, 2, 2), (1, b"z " * 49 + b"z", 1, 9)], 50)}
    assert out[a] == [5, 2, 5] and out[b"z " * 49 + b"z"] == [1] and b not in out


def test_word_hashes_do_not_depend_on_the_place():
    from larkspur.llm import words as w

    rng = random.Random(6)
    parts = [rng.choice(["a", "b", "ab", "ba", "é", "日本", "x" * 70_000, "y" * 65_536, "z" * 65_537]) for _ in range(400)]
    text = ("\x0b \n" + "  ".join(parts) + "\t ").encode()
    joined, starts = w.tokens(text)
    assert joined.tobytes() == b" ".join(text.split())
    of = {}
    for word, h in zip(text.split(), w.token_hashes(joined, starts).tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of) == 9
    assert w.token_hashes(*w.tokens(b"y" * 65_536)).tolist() == [of[b"y" * 65_536]]
    for blank in (b"", b" \n "):
        assert len(w.token_hashes(*w.tokens(blank))) == 0


@pytest.mark.parametrize("k", [1, 2, 5, 7, 8, 50])
def test_window_hashes_equal_the_sums(k):
    from larkspur.llm import words as w

    h = np.arange(60, dtype=np.uint64) * np.uint64(w.BASE)
    want = []
    for i in range(60 - k + 1):
        x = 0
        for y in h[i : i + k].tolist():
            x = (x * w.BASE + y) % 2**64
        want.append(x)
    assert w.windows(h, k).tolist() == w.mixed(np.array(want, np.uint64)).tolist()
    assert len(w.windows(h[: k - 1], k)) == 0
