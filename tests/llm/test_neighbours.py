import math
import random

import numpy as np
import pytest

from larkspur.llm import neighbours as n

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=20):
    """Exact products, added up in order, of float32 values as doubles."""
    ok = lambda r: r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v, *_ in filter(ok, rows)]
    queries = {(i, tuple(float(np.float32(x)) for x in v)) for i, v, *_ in filter(ok, queries)}
    out = []
    for qi, qv in queries:
        scored = []
        for ci, cv in rows:
            if ci != qi and len(cv) == len(qv):
                s = 0.0
                for a, b in zip(qv, cv):
                    s += a * b
                scored.append((-s, ci))
        out += [(qi, rank + 1, ci, -s) for rank, (s, ci) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def vectors(count, dims=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], 0) for i in range(count)]


def got(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "TILE_QUERIES", 7)
    monkeypatch.setattr(n, "TILE_CANDIDATES", 60)
    monkeypatch.setattr(n, "BLOCK", 16)
    rows = vectors(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert got(n.search(df, df.filter("vec_id % 20 = 0"))) == want


def test_awkward_vectors(spark):
    rows = vectors(60, 4) + [
        (100, None, 1), (120, [], 1), (140, [0.0] * 4, 1), (160, [1.0, None, 0.0, 0.0], 1), (180, [float("nan")] * 4, 1), (200, [float("inf"), 0.0, 0.0, 1.0], 1),
        (None, [1.0] * 4, None), (220, [1.0, 2.0], 1), (240, [3.0, 1.0], 1), (260, [1e-42, 0.0, 0.0, 0.0], 1), (280, [1e30, 1.0, 0.0, 0.0], 1),
        (20, rows_20 := [1.0, 1.0, 1.0, 1.0], 1), (20, rows_20, 1), (301, rows_20, 1), (300, rows_20, 1),
    ]
    rows += [(1000 + i, [9.0, 9.0, 9.0, 9.0], 2) for i in range(90)]  # a common vector
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "score")
    assert got(n.search(df, df.filter("vec_id % 20 = 0"))) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0])


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-5, 5, (50, 1)), rng.normal(size=(80, 64))
    near, off = n.Quantised(a).bounds(n.Quantised(b))
    assert (np.abs(near - a @ b.T) <= off).all()
    assert np.median(off / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))) < 0.02


def test_many_dimensions(spark):
    """Vectors of 3,072 components, multiplied in slices."""
    rng = np.random.default_rng(8)
    a = rng.integers(-127, 128, (6, 3072)).astype(float)
    a[:, 0] = 127.0
    near, off = n.Quantised(a).bounds(n.Quantised(a))
    assert (near == a @ a.T).all() and (np.abs(near - a @ a.T) <= off).all()
    rows = vectors(45, 3072, seed=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(n.search(df, df.filter("vec_id % 20 = 0"))) == brute(rows, [r for r in rows if r[0] % 20 == 0])


def test_one_id_on_many_rows(spark):
    """A query's own id on more rows than it asks for, with the vector of others."""
    rows = [(20, [1.0, 2.0, 3.0], 0)] * 60 + [(500 + i, [1.0, 2.0, 3.0], 0) for i in range(30)] + [(7, [3.0, 2.0, 1.0], 0)] * 25
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(n.search(df, df.filter("vec_id % 20 = 0"))) == brute(rows, [r for r in rows if r[0] % 20 == 0])


def test_query_and_few_candidates(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(n.op10_block_neighbours(spark, sf_dir)) == brute(rows, [r for r in rows if r[0] % 20 == 0])
    few = spark.createDataFrame(vectors(5), SCHEMA)
    assert len(got(n.search(few, few))) == 20
    empty = spark.createDataFrame([], SCHEMA)
    assert n.search(empty, empty).count() == 0
