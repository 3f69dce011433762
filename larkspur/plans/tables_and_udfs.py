"""Queries over table functions, stored tables, search orders, scripts and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import FUNCTIONS as f
from larkspur.functions import ranges
from larkspur.operators import aggregates, joins, recursion
from larkspur.session import table as t
from larkspur.sources import tables
from larkspur.streaming import events as streams

from .builders import shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def decorate(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return decorate


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def create_table_as(spark, d):
    path = shared(spark, "ctas")
    t(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region")
def insert_into_table(spark, d):
    path = shared(spark, "insert")
    t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).write.parquet(path)
    t(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("k"), F.col("r_name").alias("v")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_name) < 'customer#000000005'")
def collate_ignoring_case(spark, d):
    c = t(spark, d, "customer")
    return c.filter((F.collate("c_mktsegment", "UTF8_LCASE") == "bUiLdInG") | (F.collate("c_name", "UTF8_LCASE") < "cUSTOMER#000000005")).select("c_custkey")


@query("SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS local_ts FROM events")
def at_time_zone(spark, d):
    return t(spark, d, "events").select("event_id", f["timezone"]("Asia/Kolkata", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("local_ts"))


@query("SELECT n_nationkey, -n_nationkey AS neg, ~n_nationkey AS inv, n_nationkey << 2 AS shl, n_nationkey >> 1 AS shr, xor(n_nationkey, 5) AS x, bit_count(n_nationkey)::INT AS bits FROM nation")
def unary_and_bit_operators(spark, d):
    k = F.col("n_nationkey")
    return t(spark, d, "nation").select(k, (-k).alias("neg"), F.bitwise_not(k).alias("inv"), F.shiftleft(k, 2).alias("shl"), F.shiftright(k, 1).alias("shr"), k.bitwiseXOR(F.lit(5)).alias("x"), F.bit_count(k).alias("bits"))


@query("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS doc FROM nation GROUP BY n_regionkey")
def agg_xml(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.xmlagg(f["xmlelement"]("n", F.col("n_name")), F.col("n_name")).alias("doc"))


def _search(how: str, order: str):
    sql = f"WITH RECURSIVE w(k, depth, path) AS (SELECT 0, 0, [0] UNION ALL SELECT n_nationkey, depth + 1, list_append(path, n_nationkey) FROM w JOIN nation ON n_regionkey = k AND n_nationkey > k) SELECT k, depth, row_number() OVER (ORDER BY {order}) AS place FROM w"

    def run(spark, d):
        from pyspark.sql import Window

        edges = t(spark, d, "nation").filter("n_nationkey > n_regionkey")
        out = recursion.walk(spark.range(1).select(F.col("id").cast("int").alias("k")), edges, "k", "n_regionkey", "n_nationkey")
        return out.select("k", "depth", F.row_number().over(Window.orderBy(*recursion.search_order(how))).cast("long").alias("place"))

    run.__name__ = f"recursive_search_{how.split()[0]}"
    return query(sql)(run)


_search("depth first", "path")
_search("breadth first", "depth, path")


_PROPS = "SELECT event_id, '{\"t\": \"' || event_type || '\", \"u\": [' || user_id || ', ' || (user_id + 1) || ']}' AS doc FROM events"


def _docs(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.format_string('{"t": "%s", "u": [%d, %d]}', "event_type", "user_id", F.col("user_id") + 1).alias("doc"))


@query(f"SELECT event_id, unnest(json_keys(doc)) AS k FROM ({_PROPS})")
def json_object_keys(spark, d):
    return _docs(spark, d).select("event_id", F.explode(f["jsonb_object_keys"](F.col("doc"))).alias("k"))


@query(f"SELECT event_id, unnest(from_json(doc->'u', '[\"BIGINT\"]'))::VARCHAR AS u FROM ({_PROPS})")
def json_array_elements(spark, d):
    return _docs(spark, d).select("event_id", F.explode(f["jsonb_array_elements"](f["jsonb_object_field"](F.col("doc"), F.lit("u")))).alias("u"))


@query(f"SELECT event_id, 't' AS k, doc->>'t' AS v FROM ({_PROPS}) UNION ALL SELECT event_id, 'u', replace((doc->'u')::VARCHAR, ',', ', ') FROM ({_PROPS})")
def json_each_text(spark, d):
    return _docs(spark, d).select("event_id", F.inline(f["json_each_text"](F.col("doc")))).withColumnsRenamed({"key": "k", "value": "v"})


@query(f"SELECT event_id, doc->>'t' AS t, (doc->'u'->>1)::BIGINT AS second FROM ({_PROPS})")
def json_to_record(spark, d):
    return _docs(spark, d).select("event_id", f["json_to_record"](F.col("doc"), "t string, u array<bigint>").alias("r")).select("event_id", "r.t", F.get("r.u", F.lit(1)).alias("second"))


@query(f"SELECT event_id, generate_subscripts(from_json(doc->'u', '[\"BIGINT\"]'), 1)::INT AS ord, unnest(from_json(doc->'u', '[\"BIGINT\"]')) AS u, doc->>'t' AS t FROM ({_PROPS})")
def json_table(spark, d):
    """JSON_TABLE with an ordinality and a nested path."""
    r = _docs(spark, d).select("event_id", F.from_json("doc", "t string, u array<bigint>").alias("r"))
    return r.select("event_id", "r.t", F.posexplode_outer("r.u").alias("p", "u")).select("event_id", (F.col("p") + 1).alias("ord"), "u", "t")


@query(f"SELECT event_id, u::VARCHAR AS u FROM (SELECT event_id, unnest(from_json(doc->'u', '[\"BIGINT\"]')) AS u FROM ({_PROPS})) WHERE u > 50")
def jsonb_path_query(spark, d):
    return _docs(spark, d).select("event_id", F.explode(f["jsonb_path_query"](F.col("doc"), F.lit("$.u[*] ? (@ > 50)"))).alias("u"))


@query("SELECT p_partkey, unnest(string_split_regex(p_type, '[ _]+')) AS w FROM part")
def regexp_split_to_table(spark, d):
    return t(spark, d, "part").select("p_partkey", F.explode(f["regexp_split_to_array"](F.col("p_type"), "[ _]+")).alias("w"))


@query("SELECT n_nationkey, unnest([n_name, 'x', 'y']) AS a, unnest([n_regionkey, NULL, NULL]) AS b FROM nation")
def rows_from(spark, d):
    out = tables.rows_from(t(spark, d, "nation"), a=F.array("n_name", F.lit("x"), F.lit("y")), b=F.array("n_regionkey"))
    return out.select("n_nationkey", "a", "b")


@query("SELECT p_partkey, unnest(range(1, len(string_split(p_name, ' ')) + 1))::INT AS i FROM part")
def generate_subscripts(spark, d):
    return t(spark, d, "part").select("p_partkey", f["generate_subscripts"](F.split("p_name", " ")).alias("i"))


@query("SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
def multirange_contains(spark, d):
    """Every customer number lies in the multirange of its own numbers."""
    o = t(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 7).alias("k"))
    parts = aggregates.range_parts(o.withColumn("r", ranges.discrete("bigint")(F.col("o_custkey"), F.col("o_custkey"), "[]")), ["k"], "r", "m")
    return joins.in_parts(o, parts, ["k"], "o_custkey", "m").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1")
def stream_incremental_view(spark, d):
    """A stored view kept up by foreachBatch: each batch's sums are merged with the rows there."""
    root = shared(spark, "incremental")
    state = {"path": None}

    def merge(batch, number):
        new = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
        if state["path"]:
            new = new.unionByName(batch.sparkSession.read.parquet(state["path"])).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        path = f"{root}/version-{number}"
        new.write.mode("overwrite").parquet(path)
        state["path"] = path

    streams.maintain(streams.source(spark, d), merge, f"{root}/progress")
    return spark.read.parquet(state["path"]).select("event_type", "n", F.round("v", 4).alias("v"))


@query("SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def udf_sql_table(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("nation")
    t(spark, d, "region").createOrReplaceTempView("region")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION nations_of(r INT) RETURNS TABLE(n_name STRING) RETURN SELECT n_name FROM nation WHERE n_regionkey = r")
    return spark.sql("SELECT r_regionkey, x.n_name FROM region, LATERAL nations_of(r_regionkey) AS x WHERE r_regionkey < 3")


@query("SELECT n_nationkey, n_name || '-' || repeat('x', n_regionkey) AS s FROM nation")
def udf_named_and_default_arguments(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tag(s STRING, n INT DEFAULT 1, fill STRING DEFAULT 'x') RETURNS STRING RETURN s || '-' || repeat(fill, n)")
    return spark.sql("SELECT n_nationkey, tag(n => n_regionkey, s => n_name) AS s FROM nation")


@query("SELECT n_nationkey, n_nationkey * 10 + length(n_name) AS v FROM nation")
def udf_vectorised(spark, d):
    udf = F.udf(lambda k, s: k * 10 + len(s), "int", useArrow=True)
    return t(spark, d, "nation").select("n_nationkey", udf("n_nationkey", "n_name").alias("v"))


@query("SELECT 55::BIGINT AS total")
def script_with_loop(spark, d):
    return spark.sql("""
        BEGIN
          DECLARE i INT DEFAULT 1;
          DECLARE total BIGINT DEFAULT 0;
          WHILE i <= 10 DO
            SET total = total + i;
            SET i = i + 1;
          END WHILE;
          SELECT total;
        END""")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def execute_immediate(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT n_nationkey FROM nation WHERE n_regionkey = ?' USING 2")


@query("SELECT x, y FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, y)")
def values_builder(spark, d):
    return tables.values(spark, [(1, "a"), (2, None)], "x int, y string")
