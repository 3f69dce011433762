import random
import zlib

import numpy as np
import pytest

from larkspur.llm import toxicity as t

from .common import awkward, awkward_rows, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=4, toxic=lambda insult, group: insult and group):
    """An insult is toxic only beside a group's name; each alone is harmless."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["foul"] * insult + ["tribe"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic(insult, group))))
    return rows, labels


def test_pairs_are_learnt(spark):
    rows, labels = corpus(1500)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    truth = {d: y for d, _, y in labels}
    got = t.score(docs, t.train(docs, marks)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1}
    right = np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held])
    assert right > 0.97, right
    # the best additive model is wrong on a quarter: it can't tell one term from both beyond its margin
    again = t.score(docs, t.train(docs.repartition(7), marks.repartition(3))).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_terms_that_tell_only_in_pairs(spark):
    """Toxic with exactly one of two words: neither tells anything by itself."""
    rows, labels = corpus(3000, toxic=lambda insult, group: insult != group)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = {d: y for d, _, y in labels}
    held = [r for r in t.score(docs, t.train(docs, spark.createDataFrame(labels, LABELS))).collect() if r.held_out]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) >= 0.95


def test_fit_equals_brute_force(monkeypatch):
    """Twenty steps of the same learning, with the pairs of every text written out."""
    monkeypatch.setattr(t, "EPOCHS", 20)
    monkeypatch.setattr(t, "LEAST_STEPS", 0)
    rng = np.random.default_rng(3)
    texts = [sorted(rng.choice(7, rng.integers(0, 6), replace=False).tolist()) for _ in range(40)]
    y = rng.integers(0, 2, 40).astype(float)
    flat, sizes = np.array([i for x in texts for i in x], np.int64), np.array([len(x) for x in texts])
    got = t.fit(flat, sizes, y, np.arange(7))

    r = np.random.default_rng(7)
    w, v, b = np.zeros(7), r.normal(0, 0.05, (7, t.FACTORS)), np.log((y.sum() + 0.5) / (40 - y.sum() + 0.5))
    params = np.concatenate([w, v.ravel(), [b]])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, 21):
        w, v, b = params[:7], params[7:-1].reshape(7, -1), params[-1]
        gw, gv, gb = np.zeros(7), np.zeros_like(v), 0.0
        for x, label in zip(texts, y):
            margin = b + sum(w[i] for i in x) + sum(v[i] @ v[j] for a, i in enumerate(x) for j in x[:a])
            slope = (1 / (1 + np.exp(-margin)) - label) / 40
            gb += slope
            for i in x:
                gw[i] += slope
                gv[i] += slope * sum((v[j] for j in x if j != i), np.zeros(t.FACTORS))
        grad = np.concatenate([gw + t.DECAY * w, (gv + t.DECAY * v).ravel(), [gb]])
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad**2 - m2)
        params = params - t.RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w, v, b = params[:7], params[7:-1].reshape(7, -1), params[-1]
    margins = [b + sum(w[i] for i in x) + sum(v[i] @ v[j] for a, i in enumerate(x) for j in x[:a]) for x in texts]
    assert np.allclose(got.margins(flat, sizes), margins, atol=1e-6)


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, q, y in labels]
    a, b = (t.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and (a.factor == b.factor).all() and a.bias == b.bias


def test_margin_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = t.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    texts = [[], [2], [0, 3, 8], [1, 2, 4, 5, 7]]
    got = m.margins(np.array([i for x in texts for i in x], np.int64), np.array([len(x) for x in texts]))
    want = [0.3 + sum(m.weight[x]) + sum(m.factor[a] @ m.factor[b] for i, a in enumerate(x) for b in x[:i]) for x in texts]
    assert np.allclose(got, want)


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, None), (None, 1, 1), (9, 1, 1), (25, 0, 0), (26, 0, 1), (3, 1, 1)], LABELS)
    got = t.score(docs, t.train(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in awkward_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], LABELS)
    machine = t.train(awkward(spark), none)
    assert len({r.score for r in t.score(awkward(spark), machine).collect()}) == 1
    assert t.score(empty(spark), t.train(empty(spark), none)).count() == 0


def test_held_out_accuracy(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    d = "/root/testdata/sf0.1"
    got = t.op2_toxicity_factors(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.75
    assert np.mean([r.predicted for r in clean]) < 0.005
