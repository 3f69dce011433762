"""Queries whose plans or work once grew faster than their input, or were right on one machine only."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur import plans
from larkspur.functions import FUNCTIONS as f
from larkspur.functions import maths, ranges
from larkspur.operators import aggregates, frames, joins


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lateral_limit_keeps_its_order(spark, sf_dir):
    """Without an order in the window, which row is the first depends on how blocks arrive from other executors."""
    assert re.search(r"row_number\(\) windowspecdefinition\(o_custkey#\d+L, o_totalprice#\d+ DESC NULLS LAST, o_orderkey", optimized(plans.QUERIES["join_lateral"](spark, sf_dir)))


def test_text_vectors_stay_in_python(spark, sf_dir):
    """One pass of Python, whose output is the verdicts alone."""
    plan = optimized(plans.QUERIES["fn_full_text"](spark, sf_dir))
    assert plan.count("ArrowEvalPython") == 1 and "array<struct<lexeme" not in plan
    df = spark.createDataFrame([(1, "The well-known cat & <b>a</b> the"), (2, None), (3, ""), (4, "the cat")], "i int, t string")
    v = f["to_tsvector"]("simple", F.col("t"))
    bound = df.select("i", f["ts_match"](v, "'well' & 'the'").alias("m"), f["ts_rank"](v, "'cat'").alias("r"))
    columns = df.select("i", f["ts_match"](v, F.lit("'well' & 'the'")).alias("m"), f["ts_rank"](v, F.lit("'cat'")).alias("r"))
    assert sorted(bound.collect()) == sorted(columns.collect())
    assert {r.i: r.m for r in bound.collect()} == {1: True, 2: None, 3: False, 4: False}
    assert df.select(f["ts_match"](v, None).alias("m")).distinct().collect() == [(None,)]


def test_points_in_parts_equal_brute_force(spark, sf_dir):
    """Ranges are rows that a sorted pass meets: no row carries a group's whole multirange."""
    make = ranges.discrete("bigint")
    spans = [(k, lo, hi) for k in (0, None) for lo, hi in ((None, 2), (5, 9), (7, 12), (20, 21), (30, None))] + [(1, 3, 3), (1, 4, 6), (2, None, None)]
    df = spark.createDataFrame(spans, "k int, lo long, hi long").withColumn("r", make(F.col("lo"), F.col("hi")))
    points = [(k, x, i) for k in (0, 1, 2, 3, None) for x in (*range(-3, 40), None) for i in range(2)]
    inside = lambda k, x: x is not None and any(a == k and (lo is None or lo <= x) and (hi is None or x < hi) for a, lo, hi in spans)
    for cuts in (2, 5, 64):
        out = joins.in_parts(spark.createDataFrame(points, "k int, x long, i int"), aggregates.range_parts(df, ["k"], "r", "m"), ["k"], "x", "m", cuts)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(p) for p in points if inside(*p[:2]))
    assert "exists(" not in optimized(plans.QUERIES["multirange_contains"](spark, sf_dir))


def test_streams_write_from_the_executors(spark, sf_dir):
    """A stream's rows are files of the executors, in all modes, and not a table in the driver's memory."""
    for name in ("stream_sessions", "stream_stateful", "stream_deduplicated"):
        plan = optimized(plans.QUERIES[name](spark, sf_dir))
        assert "parquet" in plan and "MemoryPlan" not in plan
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


ROWS = [(g, x, i) for g in ("a", None) for i, x in enumerate([1.0, 1.0, 0.0, -0.0, None, None, float("nan"), 7.0, 3.0, 3.0, 3.0])] + [("one", 5.0, 0)]


@pytest.mark.parametrize("few", [100_000, 3])
def test_ranks_by_peer_groups(spark, monkeypatch, few):
    """As windows over the rows give them, whether one task numbers the groups or ranges of them are put together."""
    monkeypatch.setattr(frames, "FEW", few)
    df = spark.createDataFrame(ROWS, "g string, x double, i int")
    for partition in ([], ["g"]):
        for down in (False, True):
            w = Window.partitionBy(*partition).orderBy(F.col("x").desc_nulls_last() if down else F.col("x").asc_nulls_last())
            after = F.count("*").over(Window.partitionBy(*partition)) - F.count("*").over(w)
            kinds = {"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w), "rows_to": F.count("*").over(w), "rows_after": after}
            out = frames.ranks(df, partition, [(F.col("x"), down)], {k: k for k in kinds})
            assert sorted(map(str, out.collect())) == sorted(map(str, df.select("*", *[c.alias(k) for k, c in kinds.items()]).collect()))


@pytest.mark.parametrize("few", [100_000, 3])
def test_groups_by_peer_groups(spark, monkeypatch, few):
    monkeypatch.setattr(frames, "FEW", few)
    df = spark.createDataFrame(ROWS, "g string, x double, i int")
    for start, end in ((-1, 1), (1, 2), (-3, -2), (Window.unboundedPreceding, 0)):
        out = frames.groups(df, ["g"], [(F.col("x"), False)], start, end, {"n": ("count", F.col("x")), "s": ("sum", F.col("i")), "low": ("min", F.col("i"))})
        ranked = df.withColumn("_d", F.dense_rank().over(Window.partitionBy("g").orderBy(F.col("x").asc_nulls_last())))
        w = Window.partitionBy("g").orderBy("_d").rangeBetween(start, end)
        plain = ranked.select("g", "x", "i", F.count("x").over(w).alias("n"), F.sum("i").over(w).alias("s"), F.min("i").over(w).alias("low"))
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name, table", [("win_groups_frame", "lineitem"), ("win_ranking_ties", "lineitem"), ("win_default_frame_ties", "lineitem"), ("join_theta", "supplier")])
def test_windows_read_groups_and_not_rows(spark, sf_dir, name, table):
    """Every window stands above an aggregation, and no join is without keys."""
    plan = optimized(plans.QUERIES[name](spark, sf_dir))
    lines = [line for line in plan.splitlines() if re.search(r"[-:|+ ]*(Window|Aggregate|Relation|Join)\b", line)]
    for i, line in enumerate(lines):
        assert "Window" not in line or "Aggregate" in next(x for x in lines[i + 1 :] if "Window" not in x)
    assert "<" not in re.sub(r"<=>|<[a-z_:,]*>", "", " ".join(x for x in lines if "Join" in x))


def test_costly_numbers_are_reckoned_once_for_a_value(monkeypatch):
    """Whatever repeats in a column is looked up; equal decimals of other scales still have their own scale."""
    calls = []
    monkeypatch.setattr(maths, "_crc32c_short", maths.kept(lambda data: calls.append(data) or maths._crc32c_of(data)))
    assert [maths._crc32c(b"123456789") for _ in range(50)] == [3808858755] * 50 and len(calls) == 1
    assert maths._crc32c(b"") == 0 and maths._crc32c(b"\x00" * 32) == 0x8A9136AA and maths._crc32c(b"\xff" * 1000) == maths._crc32c_of(b"\xff" * 1000)


def test_scales_of_equal_numbers(spark):
    df = spark.createDataFrame([("1.0",), ("1.00",), ("1",), (None,), ("1.0",)], "x string")
    assert [tuple(r) for r in df.select(f["scale"](F.col("x")), f["min_scale"](F.col("x")), f["trim_scale"](F.col("x"))).collect()] == [(1, 0, "1"), (2, 0, "1"), (0, 0, "1"), (None, None, None), (1, 0, "1")]
