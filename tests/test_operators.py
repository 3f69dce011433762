"""Edge cases of the operators: nulls, ties, repetitions, empty sides."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import aggregates, dml, frames, joins, partitions, recursion, rows, search, vectors
from larkspur.sources import copy, tables


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_as_of_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 1, 3), (None, 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("a", 10, "z")], "k string, rt int, v string")
    pick = lambda strict: {r.id: r.v for r in joins.as_of(left, right, ["k"], "t", "rt", strict).collect()}
    assert pick(False) == {1: "x", 2: "z", 3: None, 4: None}
    assert pick(True) == {1: None, 2: "y", 3: None, 4: None}


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    assert got(joins.not_in(left, "x", right(2), "y")) == [(1,)]
    assert got(joins.not_in(left, "x", right(2, None), "y")) == []
    assert len(got(joins.not_in(left, "x", right(), "y"))) == 3


def test_quantified(spark):
    left = spark.createDataFrame([(1,), (5,)], "x int")
    right = spark.createDataFrame([(3,), (None,)], "y int")
    none = right.limit(0)
    assert got(joins.any_of(left, F.col("x"), right, "y", ">")) == [(5,)]
    assert got(joins.all_of(left, F.col("x"), right, "y", ">")) == []
    assert got(joins.all_of(left, F.col("x"), none, "y", ">")) == [(1,), (5,)]
    assert got(joins.any_of(left, F.col("x"), none, "y", ">")) == []
    assert got(joins.any_of(left, F.col("x"), spark.createDataFrame([(5,)], "y int"), "y", "=")) == [(5,)]


def test_salted_equals_plain(spark):
    big = spark.createDataFrame([(1, i) for i in range(200)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k int, v int")
    small = spark.createDataFrame([(k, f"s{k}") for k in range(30)] + [(1, "again")], "k int, s string")
    hot = joins.heavy_keys(big, ["k"], 0.1)
    assert got(hot) == [(1,)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, "k", how)
        assert got(joins.salted(big, small, ["k"], hot, 4, how).select(plain.columns)) == got(plain)
    with pytest.raises(ValueError):
        joins.salted(big, small, ["k"], hot, 4, "full")


def test_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, None), (5, 1)], "id int, v int")
    assert got(rows.with_ties(df, 2, [(F.col("v"), False)]))[:3] == [(2, 4), (3, 4), (5, 1)]
    assert got(rows.with_ties(df, 1, [(F.col("v"), True)])) == [(4, None)]


def test_distinct_on_forms_agree(spark):
    df = spark.createDataFrame([(k % 5, v * 7 % 11, str(v)) for k in range(10) for v in range(9)] + [(None, 1, "n")], "k int, v int, s string")
    a = rows.distinct_on(df, ["k"], [F.col("v").asc(), F.col("s").asc()])
    assert got(a) == got(rows.distinct_on_values(df, ["k"], F.struct("v", "s")))


def test_exclusion_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, None), (3, 2, 5.0)], "id int, o int, v double")
    out = frames.excluding(df, [], [F.col("o").asc_nulls_last()], F.col("v"), "current row", {"s": "sum"}, Window.unboundedPreceding, 0, "groups")
    assert {r.id: r.s for r in out.collect()} == {1: None, 2: 10.0, 3: 10.0}


def test_exclusion_keeps_types_and_values(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big), (2, 1), (3, None)], "o int, v long")
    frame = {"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}
    out = frames.excluding(df, [], [F.col("o").asc()], F.col("v"), "current row", {"s": "sum", "n": "count", "a": "array_agg"}, **frame)
    assert sorted((r.o, r.s, r.n, r.a) for r in out.collect()) == [(1, 1, 1, [1, None]), (2, big, 1, [big, None]), (3, big + 1, 2, [big, 1])]
    assert dict(out.dtypes)["s"] == "bigint"
    df = spark.createDataFrame([(1, float("inf")), (2, 1.0), (3, 2.0)], "o int, v double")
    out = frames.excluding(df, [], [F.col("o").asc()], F.col("v"), "current row", {"s": "sum"}, **frame)
    assert sorted((r.o, r.s) for r in out.collect()) == [(1, 3.0), (2, float("inf")), (3, float("inf"))]
    df = df.select("o", F.col("o").cast("decimal(38,2)").alias("v"))
    out = frames.excluding(df, [], [F.col("o").asc()], F.col("v"), "ties", {"s": "sum", "m": "avg"}, **frame)
    assert [str(r.s) for r in out.collect()] == ["6.00"] * 3


@pytest.mark.parametrize("unit", ["rows", "groups"])
@pytest.mark.parametrize("exclude", ["current row", "group", "ties", "no others"])
def test_exclusion_equals_brute_force(spark, unit, exclude):
    """Every aggregate over bounded and open frames, with peers of one value, nulls and a second partition."""
    data = [(p, o, None if o == 3 else 10 * p + o) for p in (1, 2) for o in (1, 1, 1, 2, 3, 3, 4, 4, 5)]
    df = spark.createDataFrame(data, "p int, o int, v int")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    how = {"s": "sum", "n": "count", "lo": "min", "hi": "max", "m": "avg", "a": "array_agg"}
    for start, end in ((first, 0), (-2, 1), (first, last), (0, last), (-4, -1), (1, 3), (first, -2), (2, last), (first, 1), (-1, last)):
        out = frames.excluding(df, ["p"], [F.col("o").asc()], F.col("v"), exclude, how, start, end, unit)
        want = []
        for p in (1, 2):
            rows_ = [r for r in data if r[0] == p]
            rank = {o: i for i, o in enumerate(sorted({r[1] for r in rows_}))}
            for i, r in enumerate(rows_):
                at = lambda j: j - i if unit == "rows" else rank[rows_[j][1]] - rank[r[1]]  # noqa: E731, B023
                left = [j for j in range(len(rows_)) if max(start, -99) <= at(j) <= min(end, 99)]
                peers = [j for j in left if rows_[j][1] == r[1]]
                gone = {"current row": [i], "group": peers, "ties": [j for j in peers if j != i], "no others": []}[exclude]
                a = [rows_[j][2] for j in left if j not in gone]
                v = [x for x in a if x is not None]
                want.append((p, r[1], sum(v) if v else None, len(v), min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None, a))
        have = [(r.p, r.o, r.s, r.n, r.lo, r.hi, r.m, [] if r.a is None else list(r.a)) for r in out.collect()]
        key = lambda x: repr(x)
        assert sorted(have, key=key) == sorted(want, key=key), (start, end)


def test_distinct_counts_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, None), (2, 6)], "k int, v int")
    assert got(aggregates.count_distinct_salted(df, ["k"], "v")) == [(1, 0), (2, 2)]


def test_json_objects_with_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", None, 2), ("a", 3, 3)], "k string, v int, o int")
    row = df.agg(aggregates.json_object_agg(F.col("k"), F.col("v")).alias("j"), aggregates.jsonb_object_agg(F.col("k"), F.col("v"), F.col("o")).alias("b"), aggregates.json_object_agg_strict(F.col("k"), F.col("v")).alias("s")).first()
    assert list(row) == ['{"a":1,"a":3,"b":null}', '{"a":3,"b":null}', '{"a":1,"a":3}']


def test_range_agg(spark):
    from larkspur.functions import ranges

    df = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 8, 9), (1, 2, 4), (1, 1, 3), (2, 5, None), (2, 1, 2), (2, 7, 9), (3, None, None)], "k int, a long, b long")
    df = df.withColumn("r", F.when(F.col("k") < 3, ranges.discrete("bigint")(F.col("a"), F.col("b"))))
    out = {r.k: r.m and [(x["lower"], x["upper"]) for x in r.m] for r in aggregates.range_agg(df, ["k"], "r", "m").collect()}
    assert out == {1: [(1, 5), (8, 9)], 2: [(1, 2), (5, None)], 3: None}


def test_array_agg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, v string")
    row = df.agg(aggregates.array_agg(F.col("v"), F.col("i")).alias("a"), aggregates.json_agg(F.col("v"), F.col("i")).alias("j"), aggregates.json_agg_strict(F.col("v"), F.col("i")).alias("s")).first()
    assert row.a == ["b", None, "a"] and row.j == '["b",null,"a"]' and row.s == '["b","a"]'


def test_recursive_union_with_nulls(spark):
    seed = spark.createDataFrame([(None,), (1,), (1,)], "x int")
    out = recursion.recursive_union(seed, lambda d: d.select(F.when(F.col("x") < 4, F.col("x") + 1).alias("x")))
    assert got(out) == [(1,), (2,), (3,), (4,), (None,)]
    with pytest.raises(RuntimeError):
        recursion.recursive_union(seed, lambda d: d.select((F.col("x") + 1).alias("x")), 3)


def test_search_orders(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (4, 1)], "a int, b int")
    w = recursion.walk(spark.createDataFrame([(1,)], "k int"), edges, "k", "a", "b")
    assert [r.k for r in w.filter("NOT is_cycle").orderBy(*recursion.search_order("depth first")).collect()] == [1, 2, 4, 3, 5]
    assert [r.k for r in w.filter("NOT is_cycle").orderBy(*recursion.search_order("breadth first")).collect()] == [1, 2, 3, 4, 5]
    assert [r.path for r in w.filter("is_cycle").collect()] == [[1, 2, 4, 1]]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert got(dml.delete(t, F.col("v") == "a")) == [(2, None), (3, "c")]
    assert got(dml.update(t, {"v": F.lit("z")}, F.col("v") == "a")) == [(1, "z"), (2, None), (3, "c")]
    new = spark.createDataFrame([(1, "n"), (9, "n")], "k int, v string")
    assert got(dml.upsert(t, new, ["k"])) == [(1, "a"), (2, None), (3, "c"), (9, "n")]
    assert got(dml.upsert(t, new, ["k"], {"v": F.col("s.v")})) == [(1, "n"), (2, None), (3, "c"), (9, "n")]
    assert got(dml.update_from(t, new.withColumnRenamed("v", "w"), ["k"], {"v": F.concat("t.v", "s.w")})) == [(1, "an"), (2, None), (3, "c")]
    assert got(dml.insert(t, new)) == sorted(got(t) + got(new), key=str)
    m = dml.merge(t, new, ["k"], {"v": F.col("s.v")}, None, {"k": F.col("s.k"), "v": F.col("s.v")}, with_action=True)
    assert got(dml.returning(m).select("k", "merge_action")) == [(1, "UPDATE"), (9, "INSERT")]


def test_second_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], "k int, v string")
    twice = spark.createDataFrame([(1, "n"), (1, "m"), (9, "q"), (9, "p"), (None, "y"), (None, "y")], "k int, v string")
    assert got(dml.update_from(t, twice, ["k"], {"v": F.col("s.v")})) == [(1, "m"), (2, None), (None, "x")]
    with pytest.raises(Exception, match="second time"):
        dml.upsert(t, twice, ["k"], {"v": F.col("s.v")}).collect()
    nothing = [(1, "a"), (2, None), (9, "p"), (None, "x"), (None, "y"), (None, "y")]
    assert got(dml.upsert(t, twice, ["k"])) == nothing
    assert got(dml.insert_ignore(t, twice, ["k"])) == nothing
    with pytest.raises(Exception, match="second time"):
        dml.merge(t, twice, ["k"], {"v": F.col("s.v")}).collect()
    # of two matches, only one acts
    one = dml.merge(t, twice, ["k"], clauses=[dml.When("matched", "update", {"v": F.col("s.v")}, F.col("s.v") == "n")])
    assert got(one) == [(1, "n"), (2, None), (None, "x")]
    assert got(dml.merge(t, twice, ["k"], clauses=[])) == [(1, "a"), (2, None), (None, "x")]


def test_merge_with_several_clauses(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "k int, v string")
    s = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (8, 80), (9, 90)], "k int, w int")
    clauses = [
        dml.When("matched", "nothing", None, F.col("s.w") == 10),
        dml.When("matched", "delete", None, F.col("s.w") == 20),
        dml.When("matched", "update", {"v": F.concat("t.v", F.lit("!"))}),
        dml.When("not matched", "insert", {"k": F.col("s.k"), "v": F.lit("high")}, F.col("s.w") > 85),
        dml.When("not matched", "insert", {"k": F.col("s.k")}),
        dml.When("not matched by source", "update", {"v": F.lit("gone")}, F.col("t.k") == 4),
        dml.When("not matched by source", "delete"),
    ]
    assert got(dml.merge(t, s, ["k"], clauses=clauses)) == [(1, "a"), (3, "c!"), (4, "gone"), (8, None), (9, "high")]
    touched = dml.returning(dml.merge(t, s, ["k"], clauses=clauses, with_action=True))
    assert got(touched.select("k", "merge_action")) == [(2, "DELETE"), (3, "UPDATE"), (4, "UPDATE"), (5, "DELETE"), (8, "INSERT"), (9, "INSERT")]


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 2, 3), (4, 5, 6), (0, 0, 0)))
    row = spark.range(1).select(vectors.l2_distance(a, b), vectors.negative_inner_product(a, b), F.round(vectors.cosine_distance(a, b), 6), F.isnan(vectors.cosine_distance(a, z)), vectors.from_sq8(vectors.sq8(a))).first()
    assert list(row)[:4] == [27**0.5, -32.0, 0.025368, True]
    assert all(abs(x - y) < 0.01 for x, y in zip(row[4], (1, 2, 3)))


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (5, "b"), (10, "c"), (None, "a")], "x int, s string")
    assert [r[0] for r in df.select(partitions.by_range(F.col("x"), {"lo": (None, 5), "hi": (5, 10)})).collect()] == ["lo", "hi", "DEFAULT", "DEFAULT"]
    assert [r[0] for r in df.select(partitions.by_list(F.col("s"), {"n": [None], "ab": ["a", "b"]})).collect()] == ["n", "ab", "DEFAULT", "ab"]
    partitions.write_partitioned(df, partitions.by_range(F.col("x"), {"lo": (None, 5)}), str(tmp_path / "p"))
    part = spark.read.parquet(str(tmp_path / "p")).filter("part = 'lo'")
    assert got(part.select("x")) == [(1,)] and "PartitionFilters: [isnotnull(part" in part._jdf.queryExecution().toString()
    seen = []
    view = partitions.MaterializedView(spark, str(tmp_path / "v"), lambda: df, lambda: len(seen))
    assert view.refresh() and not view.refresh()
    seen.append(1)
    assert view.refresh() and view.read().count() == 4


def test_cursor(spark):
    c = partitions.Cursor(spark.range(10), [F.col("id")])
    ids = lambda rows_: [r.id for r in rows_]
    assert ids(c.fetch(3)) == [0, 1, 2]
    assert ids(c.fetch(-2)) == [1, 0]
    assert ids(c.absolute(5)) == [4]
    c.move(2)
    assert ids(c.fetch()) == [7]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 4, 9), (None, "c", 20, 21)], "k int, s string, lo int, hi int")
    c = partitions.Constraints(df.withColumn("g", F.lit(1)))
    assert c.not_null("k").count() == 1 and got(c.unique("k")) == [(1,)]
    assert c.check(F.col("k") > 1).count() == 2
    assert c.foreign_key("k", spark.createDataFrame([(2,)], "id int"), "id").count() == 2
    assert c.exclude_overlaps("g", "lo", "hi").count() == 1


def test_copy_round_trips(spark, tmp_path):
    rows_ = [(1, "tab\there", 1.5), (2, "line\nbreak \\N back\\slash", None), (3, None, 2.0), (4, "", 0.0), (5, 'quo"te, comma', 1.0)]
    df = spark.createDataFrame(rows_, "i int, s string, d double")
    for n, delimiter in enumerate(("\t", "|")):
        copy.write_text(df, str(tmp_path / f"t{n}"), delimiter)
        assert got(copy.read_text(spark, str(tmp_path / f"t{n}"), "i int, s string, d double", delimiter)) == got(df)
    copy.write_csv(df, str(tmp_path / "c"))
    assert got(copy.read_csv(spark, str(tmp_path / "c"), "i int, s string, d double")) == got(df)
    (tmp_path / "bad").write_text("1\n")
    with pytest.raises(Exception, match="wrong number"):
        copy.read_text(spark, str(tmp_path / "bad"), "i int, s string").collect()


@pytest.mark.parametrize("delimiter", ["\t", "|", ","])
def test_copy_text_holds_every_character(spark, tmp_path, delimiter):
    rows_ = [(i, chr(i), f"x{chr(i)}{chr(i)}y\\") for i in range(1, 128)] + [(200, "é 日本 \u2028", ""), (201, "\\" * 5_000, "\n" * 5_000), (202, "\\N", None)]
    df = spark.createDataFrame(rows_, "i int, s string, u string")
    copy.write_text(df, str(tmp_path / "t"), delimiter)
    assert got(copy.read_text(spark, str(tmp_path / "t"), "i int, s string, u string", delimiter)) == got(df)
    copy.write_csv(df.filter("i > 31 AND i < 200"), str(tmp_path / "c"))
    assert got(copy.read_csv(spark, str(tmp_path / "c"), "i int, s string, u string")) == got(df.filter("i > 31 AND i < 200"))


def test_copy_text_escapes(spark, tmp_path):
    line = r"\x41\101\b\f\v\q|\xc3\xa9\|\x4|\N|\\N|\x|\0501" + "\n"
    (tmp_path / "e").write_text(line)
    row = copy.read_text(spark, str(tmp_path / "e"), "a string, b string, c string, d string, e string, f string", "|").first()
    assert row.a == "AA\b\f\vq" and row.b == "é|\x04" and row.c is None and row.d == "\\N" and row.e == "x" and row.f == "(1"


def test_sources(spark):
    assert [r[0] for r in tables.series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    df = spark.createDataFrame([(1, ["a", "b"], [7])], "i int, x array<string>, y array<int>")
    assert got(tables.with_ordinality(df.select("i", "x"), "x", "v")) == [(1, "a", 1), (1, "b", 2)]
    out = tables.rows_from(df.select("i", "x", "y"), p=F.col("x"), q=F.col("y"))
    assert got(out.select("p", "q")) == [("a", 7), ("b", None)]


def test_index_and_similarity(spark):
    df = spark.createDataFrame([(1, "Big cats run"), (2, "a big dog"), (3, None)], "id int, s string")
    index = search.inverted_index(df, "id", "s", "english")
    assert got(search.all_of(index, "id", ["big", "cat"])) == [(1,)]
    assert got(search.similar(df, "s", "big dogs", 0.3).select("id")) == [(2,)]
