"""Queries that the operators build, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import ranges
from larkspur.operators import aggregates, dml, frames, joins, partitions, recursion, rows, search, vectors
from larkspur.session import shared_root
from larkspur.session import table as t
from larkspur.sources import copy, tables
from larkspur.streaming import events as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def decorate(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return decorate


def shared(spark, label: str) -> str:
    """A folder that all executors see."""
    import uuid

    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return rows.distinct_on(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT DISTINCT ON (l_suppkey) l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber")
def distinct_on_by_aggregation(spark, d):
    df = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return rows.distinct_on_values(df, ["l_suppkey"], F.struct("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 5")
def fetch_with_ties(spark, d):
    return rows.with_ties(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 5, [(F.col("l_quantity"), True)])


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_k_per_group(spark, d):
    return rows.top_k(t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


@query("SELECT * FROM nation")
def tablesample_all(spark, d):
    return rows.sample(t(spark, d, "nation"), 100)


@query("SELECT * FROM nation WHERE false")
def tablesample_none(spark, d):
    return rows.sample(t(spark, d, "nation"), 0)


@query("SELECT e.event_id, e.user_id, o.event_id AS buy FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def join_as_of(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    buys = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("buy_ts")).agg(F.max("event_id").alias("buy"))
    return joins.as_of(e.filter("event_type <> 'purchase'").drop("event_type"), buys, ["user_id"], "ts", "buy_ts").select("event_id", "user_id", "buy")


@query("SELECT o_orderkey, low FROM orders JOIN (SELECT unnest(generate_series(0, 400000, 25000))::BIGINT AS low) s ON o_totalprice >= low AND o_totalprice < low + 30000")
def join_range_buckets(spark, d):
    spans = tables.series(spark, 0, 400_000, 25_000, "low").withColumn("high", F.col("low") + 30_000)
    return joins.in_range(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), spans, "o_totalprice", "low", "high", 30_000.0).select("o_orderkey", "low")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_salted(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    hot = joins.heavy_keys(li, ["k"], 0.002)
    return joins.salted(li, t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand"), ["k"], hot).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def join_not_in(spark, d):
    return joins.not_in(t(spark, d, "nation").select("n_nationkey"), "n_nationkey", t(spark, d, "supplier"), "s_nationkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)")
def quantified_any(spark, d):
    return joins.any_of(t(spark, d, "supplier"), F.col("s_acctbal"), t(spark, d, "customer").filter("c_nationkey = 3"), "c_acctbal", ">").select("s_suppkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0)")
def quantified_all(spark, d):
    return joins.all_of(t(spark, d, "supplier"), F.col("s_acctbal"), t(spark, d, "customer").filter("c_nationkey = 3 AND c_acctbal > 0"), "c_acctbal", "<").select("s_suppkey")


_GROUPS_SQL = "SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, round(sum(l_quantity) OVER w, 2) AS s FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(_GROUPS_SQL)
def win_groups_frame(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return frames.groups(df, ["l_returnflag"], [(F.col("l_quantity"), False)], -1, 1, {"n": ("count", F.lit(1)), "s": ("sum", F.col("l_quantity"))}).select("l_orderkey", "l_linenumber", "n", F.round("s", 2).alias("s"))


@query("SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)")
def win_ranking_ties(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    out = frames.ranks(df, ["l_returnflag"], [(F.col("l_quantity"), False)], {"rk": "rank", "dr": "dense_rank", "pr": "percent_rank", "cd": "cume_dist"})
    return out.select("l_orderkey", "l_linenumber", "rk", "dr", F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS n FROM lineitem")
def win_default_frame_ties(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return frames.ranks(df, ["l_returnflag"], [(F.col("l_quantity"), False)], {"n": "rows_to"}).select("l_orderkey", "l_linenumber", "n")


@query("SELECT count(*) AS n, sum(a.s_suppkey) AS s FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey <> b.s_nationkey")
def join_theta(spark, d):
    """Of each row's pairs only their number is asked: all rows beyond it, less those of its own nation."""
    s = t(spark, d, "supplier").filter("s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL").select("s_suppkey", "s_nationkey", "s_acctbal")
    s = frames.ranks(s, [], [(F.col("s_acctbal"), False)], {"_beyond": "rows_after"})
    s = frames.ranks(s, ["s_nationkey"], [(F.col("s_acctbal"), False)], {"_own": "rows_after"})
    pairs = F.col("_beyond") - F.col("_own")
    return s.agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("n"), F.sum(F.when(pairs > 0, F.col("s_suppkey") * pairs)).alias("s"))


_OVER_FRAME = {"s": "sum", "n": "count", "low": "min", "high": "max", "mean": "avg"}


def _excluding(how):
    frame = f"(PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {how.upper()})"
    sql = f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, count(o_totalprice) OVER w AS n, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER w AS high, round(avg(o_totalprice) OVER w, 6) AS mean FROM orders WINDOW w AS {frame}"

    def run(spark, d):
        df = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        out = frames.excluding(df, ["o_custkey"], [F.col("o_orderstatus").asc_nulls_last()], F.col("o_totalprice"), how, _OVER_FRAME, unit="groups")
        return out.select("o_orderkey", F.round("s", 2).alias("s"), "n", "low", "high", F.round("mean", 6).alias("mean"))

    run.__name__ = f"win_exclude_{how.replace(' ', '_')}"
    return query(sql)(run)


for _how in ("current row", "group", "ties", "no others"):
    _excluding(_how)


def _excluding_rows(how):
    # peers have the same value, so it does not matter which of them a frame of rows holds
    frame = f"(PARTITION BY o_custkey ORDER BY y ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE {how.upper()})"
    sql = f"SELECT o_custkey, y, sum(y) OVER w AS s, count(y) OVER w AS n, min(y) OVER w AS low, max(y) OVER w AS high, array_to_string(list_sort(list(y) OVER w), ',') AS ys FROM (SELECT o_custkey, year(o_orderdate)::BIGINT AS y FROM orders) WINDOW w AS {frame}"

    def run(spark, d):
        df = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y"))
        out = frames.excluding(df, ["o_custkey"], [F.col("y").asc_nulls_last()], F.col("y"), how, {"s": "sum", "n": "count", "low": "min", "high": "max", "ys": "array_agg"}, -3, 2, "rows")
        listed = F.array_join(F.transform(F.sort_array("ys"), lambda x: x.cast("string")), ",")
        return out.select("o_custkey", "y", "s", "n", "low", "high", F.when(F.size("ys") > 0, listed).alias("ys"))

    run.__name__ = f"win_rows_exclude_{how.replace(' ', '_')}"
    return query(sql)(run)


for _how in ("current row", "group", "ties"):
    _excluding_rows(_how)


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 100000) + 1 AS r, count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 100000) + 1 AS dr, round(count(*) FILTER (WHERE o_totalprice < 100000) / count(*), 9) AS pr, round((count(*) FILTER (WHERE o_totalprice <= 100000) + 1) / (count(*) + 1), 9) AS cd FROM orders GROUP BY o_orderstatus")
def agg_hypothetical(spark, d):
    p = F.col("o_totalprice")
    a = aggregates
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(a.hypothetical_rank(p, 100000.0).alias("r"), a.hypothetical_dense_rank(p, 100000.0).alias("dr"), F.round(a.hypothetical_percent_rank(p, 100000.0), 9).alias("pr"), F.round(a.hypothetical_cume_dist(p, 100000.0), 9).alias("cd"))


@query("SELECT n_regionkey, to_json(list(n_name ORDER BY n_nationkey))::VARCHAR AS names, string_agg(n_name, '; ' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def agg_json_and_string(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.json_agg(F.col("n_name"), F.col("n_nationkey")).alias("names"), aggregates.string_agg(F.col("n_name"), "; ", F.col("n_nationkey")).alias("text"))


@query("SELECT n_regionkey, to_json(map_from_entries(list((n_name, n_nationkey) ORDER BY n_name)))::VARCHAR AS doc FROM nation GROUP BY n_regionkey")
def agg_json_object(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("doc"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_distinct_salted(spark, d):
    return aggregates.count_distinct_salted(t(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


_ISLANDS = "(SELECT *, sum(CASE WHEN o_custkey > before + 5 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS part FROM (SELECT *, lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS before FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders)))"


@query(f"SELECT o_orderstatus, (max(part))::BIGINT AS parts, min(o_custkey)::BIGINT AS low, (max(o_custkey) + 5)::BIGINT AS high, CASE WHEN max(o_custkey) < min(o_custkey) + 5 THEN max(o_custkey)::BIGINT END AS common_low, CASE WHEN max(o_custkey) < min(o_custkey) + 5 THEN (min(o_custkey) + 5)::BIGINT END AS common_high FROM {_ISLANDS} GROUP BY o_orderstatus")
def agg_ranges(spark, d):
    df = t(spark, d, "orders").withColumn("r", ranges.discrete("bigint")(F.col("o_custkey"), F.col("o_custkey") + 5))
    common = df.groupBy("o_orderstatus").agg(aggregates.range_intersect_agg(F.col("r")).alias("i"))
    both = aggregates.range_agg(df, ["o_orderstatus"], "r", "m").join(common, "o_orderstatus")
    return both.select("o_orderstatus", F.size("m").cast("long").alias("parts"), F.get("m", F.lit(0))["lower"].alias("low"), F.element_at("m", -1)["upper"].alias("high"), F.col("i.lower").alias("common_low"), F.col("i.upper").alias("common_high"))


@query("WITH RECURSIVE r(k) AS (SELECT 0::BIGINT UNION SELECT (k * 3 + 1) % 101 FROM r) SELECT k FROM r")
def recursive_union(spark, d):
    seed = spark.range(1).select(F.lit(0).cast("long").alias("k"))
    return recursion.recursive_union(seed, lambda df: df.select(((F.col("k") * 3 + 1) % 101).alias("k")))


_EDGES = "(SELECT s_suppkey AS a, (s_suppkey * 2) % 11 AS b FROM supplier UNION SELECT s_suppkey, (s_suppkey + 3) % 11 FROM supplier)"


@query(f"WITH RECURSIVE e AS {_EDGES}, w(k, depth, path, is_cycle) AS (SELECT 1::BIGINT, 0, [1::BIGINT], false UNION ALL SELECT b, depth + 1, list_append(path, b), list_contains(path, b) FROM w JOIN e ON a = k WHERE NOT is_cycle AND depth < 60) SELECT k, depth, array_to_string(path, '>') AS path, is_cycle FROM w")
def recursive_cycle(spark, d):
    s = t(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 2 % 11).alias("b")).union(s.select("s_suppkey", ((F.col("s_suppkey") + 3) % 11))).distinct()
    out = recursion.walk(spark.range(1).select(F.lit(1).cast("long").alias("k")), edges, "k", "a", "b")
    return out.select("k", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "is_cycle")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name || '!') ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'NEW'")
def dml_upsert(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    new = n.filter("n_nationkey < 5").select("n_nationkey", F.concat("n_name", F.lit("!")).alias("n_name")).unionByName(tables.values(spark, [(100, "NEW")], "n_nationkey int, n_name string"))
    return dml.upsert(n, new, ["n_nationkey"], {"n_name": F.upper("s.n_name")})


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'NEW'")
def dml_insert_ignore(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    return dml.insert_ignore(n, tables.values(spark, [(100, "NEW"), (1, "IGNORED"), (100, "OTHER")], "n_nationkey int, n_name string"), ["n_nationkey"])


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN s_acctbal + 1000 ELSE s_acctbal END AS s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def dml_update_from(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return dml.update_from(s, n, ["s_nationkey"], {"s_acctbal": F.col("t.s_acctbal") + 1000}).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, d):
    return dml.update(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def dml_delete(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    idle = joins.anti(c, t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("c_custkey", "k")
    return dml.delete_using(c, idle, F.col("c_custkey") == F.col("k"))


_MERGE_SOURCE = "(SELECT n_nationkey AS k, n_name || '*' AS v FROM nation WHERE n_nationkey BETWEEN 3 AND 12 UNION ALL SELECT 200, 'X')"


@query(f"WITH s AS {_MERGE_SOURCE} SELECT n_nationkey, coalesce(s.v, n_name) AS n_name FROM nation LEFT JOIN s ON k = n_nationkey WHERE NOT (k IS NOT NULL AND n_regionkey = 2) AND NOT (k IS NULL AND n_nationkey > 20) UNION ALL SELECT 200, 'X'")
def dml_merge(spark, d):
    return _merged(spark, d).select("n_nationkey", "n_name")


@query(f"WITH s AS {_MERGE_SOURCE} SELECT n_nationkey, CASE WHEN k IS NOT NULL AND n_regionkey = 2 THEN 'DELETE' WHEN k IS NOT NULL THEN 'UPDATE' ELSE 'DELETE' END AS merge_action FROM nation LEFT JOIN s ON k = n_nationkey WHERE k IS NOT NULL OR n_nationkey > 20 UNION ALL SELECT 200, 'INSERT'")
def dml_merge_returning(spark, d):
    return dml.returning(_merged(spark, d, with_action=True)).select("n_nationkey", "merge_action")


def _merged(spark, d, **options):
    n = t(spark, d, "nation")
    s = n.filter("n_nationkey BETWEEN 3 AND 12").select("n_nationkey", F.concat("n_name", F.lit("*")).alias("v")).unionByName(tables.values(spark, [(200, "X")], "n_nationkey int, v string"))
    return dml.merge(
        n, s, ["n_nationkey"], {"n_name": F.col("s.v")}, F.col("t.n_regionkey") == 2, {"n_nationkey": F.col("s.n_nationkey"), "n_name": F.col("s.v")}, F.col("t.n_nationkey") > 20, **options
    )


def _knn(how, sql_distance):
    sql = f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round({sql_distance}, 6) AS distance FROM embeddings, q ORDER BY {sql_distance}, vec_id LIMIT 10"

    def run(spark, d):
        df = t(spark, d, "embeddings")
        # one row, the query vector
        q = df.filter("vec_id = 7").select(F.col("embedding").alias("_q"))
        out = df.crossJoin(F.broadcast(q)).withColumn("distance", vectors.DISTANCES[how](F.col("embedding"), F.col("_q")))
        return out.orderBy("distance", "vec_id").limit(10).select("vec_id", F.round("distance", 6).alias("distance"))

    run.__name__ = f"knn_{how}"
    return query(sql)(run)


_knn("l2", "list_distance(embedding::DOUBLE[], e::DOUBLE[])")
_knn("inner", "-list_inner_product(embedding::DOUBLE[], e::DOUBLE[])")
_knn("cosine", "list_cosine_distance(embedding::DOUBLE[], e::DOUBLE[])")


@query("SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.1::DOUBLE)), vec_id LIMIT 5")
def knn_filtered(spark, d):
    return vectors.nearest(t(spark, d, "embeddings").filter("label = 3"), "embedding", [0.1] * 64, 5, "l2", "vec_id").select("vec_id")


@query("SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'DEFAULT' END AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_by_range(spark, d):
    p = partitions.by_range(F.col("o_totalprice"), {"low": (None, 50000), "mid": (50000, 200000)})
    return t(spark, d, "orders").groupBy(p.alias("part")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'DEFAULT' END AS part, count(*) AS n FROM orders GROUP BY 1")
def partition_by_list(spark, d):
    return t(spark, d, "orders").groupBy(partitions.by_list(F.col("o_orderstatus"), {"done": ["F", "P"], "open": ["O", None]}).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders")
def partition_by_hash(spark, d):
    parts = t(spark, d, "orders").groupBy(partitions.by_hash(F.col("o_orderkey"), 8).alias("p")).agg(F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000")
def partition_pruned_scan(spark, d):
    path = shared(spark, "orders-by-price")
    p = partitions.by_range(F.col("o_totalprice"), {"low": (None, 50000), "mid": (50000, 200000)})
    partitions.write_partitioned(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), p, path)
    return spark.read.parquet(path).filter("part = 'mid'").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM region")
def scan_one_segment(spark, d):
    return partitions.as_of_segment(spark, f"{d}/region.parquet", "region.parquet")


@query("SELECT n_nationkey AS k, n_name AS name, NULL AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def inheritance(spark, d):
    return partitions.inherit(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def materialized_view(spark, d):
    o = t(spark, d, "orders")
    view = partitions.MaterializedView(spark, shared(spark, "view"), lambda: o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), lambda: 1)
    view.refresh()
    return view.read()


@query("SELECT 'duplicate' AS broken, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'check', count(*) FROM supplier WHERE NOT s_acctbal > 0")
def constraint_checks(spark, d):
    c = partitions.Constraints
    o = t(spark, d, "orders")
    found = {"duplicate": c(o).unique("o_custkey"), "orphan": c(t(spark, d, "customer")).foreign_key("c_custkey", o, "o_custkey"), "check": c(t(spark, d, "supplier")).check(F.col("s_acctbal") > 0)}
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("broken"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
def row_security(spark, d):
    return partitions.row_security(t(spark, d, "customer"), [F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 9000]).select("c_custkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def copy_csv(spark, d):
    path = shared(spark, "csv")
    copy.write_csv(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return copy.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def copy_text(spark, d):
    path = shared(spark, "text")
    copy.write_text(t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return copy.read_text(spark, path, "event_id long, user_id long, event_type string, value double, props string")


@query("SELECT x FROM (SELECT unnest(generate_series(5, 100, 7))::BIGINT AS x)")
def generate_series(spark, d):
    return tables.series(spark, 5, 100, 7, "x")


@query("SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS ordinality, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_with_ordinality(spark, d):
    df = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return tables.with_ordinality(df, "words", "word")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'and')")
def fulltext_all_words(spark, d):
    return search.all_of(search.words_index(t(spark, d, "documents"), "doc_id", "text"), "doc_id", ["the", "and"])


_TRGM = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 5) AS similarity FROM (SELECT p_partkey, {_TRGM.format('p_name')} AS a, {_TRGM.format(chr(39) + 'part 12' + chr(39))} AS b FROM part) WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.3")
def trigram_similar(spark, d):
    return search.similar(t(spark, d, "part"), "p_name", "part 12").select("p_partkey", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return streams.run(streams.tumbling(streams.source(spark, d), "1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def stream_sliding(spark, d):
    return streams.run(streams.sliding(streams.source(spark, d), "2 hours", "1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, d):
    return streams.run(streams.sessions(streams.source(spark, d), "30 minutes")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def stream_stateful(spark, d):
    seen = streams.run(streams.running_totals(streams.source(spark, d)), "update")
    return rows.distinct_on(seen, ["user_id"], [F.desc("n")])


@query("SELECT event_type, user_id FROM events GROUP BY 1, 2")
def stream_deduplicated(spark, d):
    return streams.run(streams.first_of_each(streams.source(spark, d), ["event_type", "user_id"], "10000 days"), "append").select("event_type", "user_id")


@query("SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS v FROM nation")
def udf_sql(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT) RETURNS INT RETURN x * x + 1")
    t(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, square_plus(n_nationkey) AS v FROM nation")


@query("SELECT r_regionkey, unnest(generate_series(0, r_regionkey))::INT AS i FROM region")
def udtf_python(spark, d):
    @F.udtf(returnType="i: int")
    class Upto:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    spark.udtf.register("upto", Upto)
    t(spark, d, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, i FROM region, LATERAL upto(r_regionkey)")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY 1")
def udaf_pandas(spark, d):
    import pandas as pd

    def mean(v):
        return float(v.mean())

    mean.__annotations__ = {"v": pd.Series, "return": float}  # annotations of this module are text
    mean = F.pandas_udf(mean, "double")
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(mean("o_totalprice"), 4).alias("m"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def prepared_parameters(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 250000, "status": "F"})


@query("SELECT l_returnflag, l_linestatus, n FROM (PIVOT (SELECT l_returnflag, l_linestatus FROM lineitem) ON l_linestatus IN ('O', 'F') USING count(*)) UNPIVOT (n FOR l_linestatus IN (O, F))")
def pivot_and_back(spark, d):
    wide = t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().fillna(0)
    return wide.unpivot("l_returnflag", ["O", "F"], "l_linestatus", "n")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 20")
def cursor_page(spark, d):
    return rows.page(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 7, 20)


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s FROM orders")
def window_builder(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s"))
