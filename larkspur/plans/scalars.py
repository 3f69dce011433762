"""Scalar functions over columns of the tables, a family to a query, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import FUNCTIONS as f
from larkspur.functions import arrays, casts, dates, geometry, json_docs, network, ranges, strings
from larkspur.session import small_batches
from larkspur.session import table as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def family(name: str, source: str, keys: list[str], columns: dict, where: str = "true") -> None:
    """Register fn_<name>: for each output column a Column (made when run) and DuckDB's expression, or None without one."""

    def run(spark, d):
        small_batches(spark)
        df = t(spark, d, source).filter(where)
        return df.select(*keys, *[make().alias(c) for c, (make, _) in columns.items()])

    QUERIES[f"fn_{name}"] = run
    if all(sql is not None for _, sql in columns.values()):
        ORACLE_SQL[f"fn_{name}"] = f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {c}' for c, (_, sql) in columns.items())} FROM {source} WHERE {where}"


c = F.col

family("string_case", "part", ["p_partkey"], {
    "up": (lambda: f["upper"](c("p_name")), "upper(p_name)"),
    "uc": (lambda: f["ucase"](c("p_name")), "upper(p_name)"),
    "low": (lambda: f["lower"](c("p_type")), "lower(p_type)"),
    "lc": (lambda: f["lcase"](c("p_type")), "lower(p_type)"),
    "rev": (lambda: f["reverse"](c("p_name")), "reverse(p_name)"),
    "len": (lambda: f["length"](c("p_name")), "length(p_name)::INT"),
    "cl": (lambda: f["char_length"](c("p_name")), "length(p_name)::INT"),
    "ol": (lambda: f["octet_length"](c("p_name")), "strlen(p_name)::INT"),
    "bl": (lambda: f["bit_length"](c("p_name")), "(8 * strlen(p_name))::INT"),
})
family("string_parts", "customer", ["c_custkey"], {
    "l": (lambda: f["left"](c("c_name"), 4), "left(c_name, 4)"),
    "ln": (lambda: f["left"](c("c_name"), -4), "left(c_name, -4)"),
    "r": (lambda: f["right"](c("c_name"), 3), "right(c_name, 3)"),
    "rn": (lambda: f["right"](c("c_name"), -3), "right(c_name, -3)"),
    "s": (lambda: f["substr"](c("c_name"), 2, 5), "substr(c_name, 2, 5)"),
    "sp": (lambda: f["split_part"](c("c_name"), "#", 2), "split_part(c_name, '#', 2)"),
    "at": (lambda: f["strpos"](c("c_name"), "#"), "strpos(c_name, '#')::INT"),
    "po": (lambda: f["position"]("0", c("c_name")), "strpos(c_name, '0')::INT"),
    "sw": (lambda: f["starts_with"](c("c_name"), "Cust"), "starts_with(c_name, 'Cust')"),
    "ew": (lambda: f["ends_with"](c("c_name"), "7"), "ends_with(c_name, '7')"),
    "arr": (lambda: F.array_join(f["string_to_array"](c("c_name"), "#"), "|"), "array_to_string(string_split(c_name, '#'), '|')"),
})
family("string_build", "supplier", ["s_suppkey"], {
    "cc": (lambda: f["concat"](c("s_name"), None, "-", c("s_nationkey")), "concat(s_name, NULL, '-', s_nationkey)"),
    "cw": (lambda: f["concat_ws"]("/", c("s_name"), c("s_nationkey")), "concat_ws('/', s_name, s_nationkey)"),
    "lp": (lambda: f["lpad"](c("s_nationkey").cast("string"), 5, "0"), "lpad(s_nationkey::VARCHAR, 5, '0')"),
    "rp": (lambda: f["rpad"](c("s_nationkey").cast("string"), 5, "x"), "rpad(s_nationkey::VARCHAR, 5, 'x')"),
    "rep": (lambda: f["repeat"]("ab", 3), "repeat('ab', 3)"),
    "rpl": (lambda: f["replace"](c("s_name"), "0", "o"), "replace(s_name, '0', 'o')"),
    "tr": (lambda: f["translate"](c("s_name"), "Spl", "spL"), "translate(s_name, 'Spl', 'spL')"),
    "ql": (lambda: f["quote_literal"](c("s_name")), "concat('''', replace(s_name, '''', ''''''), '''')"),
})
family("string_trim", "nation", ["n_nationkey"], {
    "b": (lambda: f["btrim"](F.concat(F.lit("  "), c("n_name"), F.lit(" "))), "trim('  ' || n_name || ' ')"),
    "l": (lambda: f["ltrim"](F.concat(F.lit("xx"), c("n_name")), "x"), "ltrim('xx' || n_name, 'x')"),
    "r": (lambda: f["rtrim"](F.concat(c("n_name"), F.lit("xyx")), "xy"), "rtrim(n_name || 'xyx', 'xy')"),
    "a": (lambda: f["ascii"](c("n_name")), "ascii(n_name)"),
    "c": (lambda: f["chr"](c("n_nationkey") + 65), "chr(n_nationkey + 65)"),
    "lev": (lambda: f["levenshtein"](c("n_name"), "NATION"), "levenshtein(n_name, 'NATION')::INT"),
    "m": (lambda: f["md5"](c("n_name")), "md5(n_name)"),
    "h": (lambda: F.lower(F.hex(f["sha256"](c("n_name")))), "sha256(n_name)"),
    "b64": (lambda: f["to_base64"](c("n_name")), "to_base64(encode(n_name))"),
    "hx": (lambda: f["to_hex"](c("n_nationkey")), "lower(to_hex(n_nationkey))"),
    "bn": (lambda: f["to_bin"](c("n_nationkey")), "to_binary(n_nationkey)"),
})
family("regular_expressions", "part", ["p_partkey"], {
    "first": (lambda: f["regexp_replace"](c("p_name"), "[aeiou]", "*"), "regexp_replace(p_name, '[aeiou]', '*')"),
    "every": (lambda: f["regexp_replace"](c("p_name"), "[aeiou]", "*", "g"), "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    "groups": (lambda: f["regexp_replace"](c("p_name"), "([a-z])([a-z])", r"\2\1", "g"), r"regexp_replace(p_name, '([a-z])([a-z])', '\2\1', 'g')"),
    "n": (lambda: f["regexp_count"](c("p_name"), "[0-9]"), "len(regexp_extract_all(p_name, '[0-9]'))::INT"),
    "likes": (lambda: f["regexp_like"](c("p_name"), "^P.*1$", "i"), "regexp_matches(p_name, '(?i)^P.*1$')"),
    "second": (lambda: F.coalesce(f["regexp_substr"](c("p_name"), "[0-9]", 1, 2), F.lit("-")), "coalesce(regexp_extract_all(p_name, '[0-9]')[2], '-')"),
    "split": (lambda: F.array_join(f["regexp_split_to_array"](c("p_type"), "[ _]+"), "|"), "array_to_string(string_split_regex(p_type, '[ _]+'), '|')"),
    "similar": (lambda: strings.similar_to(c("p_type"), "%(STEEL|BRASS)"), "p_type SIMILAR TO '.*(STEEL|BRASS)'"),
})
family("rounding", "lineitem", ["l_orderkey", "l_linenumber"], {
    "a": (lambda: f["abs"](-c("l_quantity")), "abs(-l_quantity)"),
    "ce": (lambda: f["ceil"](c("l_extendedprice") / 7), "ceil(l_extendedprice / 7)::BIGINT"),
    "fl": (lambda: f["floor"](c("l_extendedprice") / 7), "floor(l_extendedprice / 7)::BIGINT"),
    "tr": (lambda: f["trunc"](-c("l_extendedprice") / 7), "trunc(-l_extendedprice / 7)::BIGINT"),
    "re": (lambda: f["round"](c("l_quantity") / 2), "round_even(l_quantity / 2, 0)"),
    "sg": (lambda: f["sign"](c("l_discount") - 0.05), "sign(l_discount - 0.05)::DOUBLE"),
    "md": (lambda: f["mod"](c("l_orderkey"), 7), "l_orderkey % 7"),
    "dv": (lambda: f["div"](c("l_orderkey"), 7).cast("long"), "l_orderkey // 7"),
    "gc": (lambda: f["gcd"](c("l_orderkey"), 36), "gcd(l_orderkey, 36)::BIGINT"),
    "lc": (lambda: f["lcm"](c("l_linenumber").cast("long"), 36), "lcm(l_linenumber, 36)::BIGINT"),
    "wb": (lambda: f["width_bucket"](c("l_quantity"), 0.0, 50.0, 10), "(floor(l_quantity / 5) + 1)::INT"),
})
family("logarithms", "part", ["p_partkey"], {
    n: (lambda n=n, e=e: F.round(e(), 9), f"round({sql}, 9)")
    for n, e, sql in (
        ("sq", lambda: f["sqrt"](c("p_retailprice")), "sqrt(p_retailprice)"),
        ("cb", lambda: f["cbrt"](c("p_retailprice")), "cbrt(p_retailprice)"),
        ("ex", lambda: f["exp"](c("p_size") / 50), "exp(p_size / 50)"),
        ("ln", lambda: f["ln"](c("p_retailprice")), "ln(p_retailprice)"),
        ("lg", lambda: f["log"](c("p_retailprice")), "log10(p_retailprice)"),
        ("l2", lambda: f["log2"](c("p_retailprice")), "log2(p_retailprice)"),
        ("lb", lambda: f["log"](3, c("p_retailprice")), "ln(p_retailprice) / ln(3)"),
        ("pw", lambda: f["power"](c("p_size"), 1.5), "pow(p_size, 1.5)"),
        ("dg", lambda: f["degrees"](c("p_size")), "degrees(p_size)"),
        ("rd", lambda: f["radians"](c("p_size")), "radians(p_size)"),
    )
})
family("trigonometry", "part", ["p_partkey"], {
    n: (lambda n=n, e=e: F.round(e(), 9), f"round({sql}, 9)")
    for n, e, sql in (
        *((fn, (lambda fn=fn: f[fn](c("p_size") / 10)), f"{fn}(p_size / 10)") for fn in ("sin", "cos", "tan", "cot", "atan", "sinh", "cosh", "tanh", "asinh")),
        ("asin", lambda: f["asin"](c("p_size") / 51), "asin(p_size / 51)"),
        ("acos", lambda: f["acos"](c("p_size") / 51), "acos(p_size / 51)"),
        ("acosh", lambda: f["acosh"](c("p_size") + 1.5), "acosh(p_size + 1.5)"),
        ("atanh", lambda: f["atanh"](c("p_size") / 51), "atanh(p_size / 51)"),
        ("atan2", lambda: f["atan2"](c("p_size"), c("p_retailprice")), "atan2(p_size, p_retailprice)"),
        ("sind", lambda: f["sind"](c("p_size")), "sin(radians(p_size))"),
        ("cosd", lambda: f["cosd"](c("p_size")), "cos(radians(p_size))"),
    )
})
family("conditional", "customer", ["c_custkey"], {
    "nn": (lambda: f["nullif"](c("c_nationkey"), 3), "nullif(c_nationkey, 3)"),
    "co": (lambda: f["coalesce"](f["nullif"](c("c_nationkey"), 3), -1), "coalesce(nullif(c_nationkey, 3), -1)"),
    "gr": (lambda: f["greatest"](c("c_acctbal"), 0.0, None), "greatest(c_acctbal, 0.0::DOUBLE)"),
    "le": (lambda: f["least"](c("c_acctbal"), 0.0), "least(c_acctbal, 0.0::DOUBLE)"),
    "i": (lambda: f["if"](c("c_acctbal") > 0, "plus", "minus"), "if(c_acctbal > 0, 'plus', 'minus')"),
    "nu": (lambda: f["num_nulls"](f["nullif"](c("c_nationkey"), 3), c("c_name")), "(c_nationkey = 3)::INT"),
})
_EXTRACT = ("year", "month", "day", "hour", "minute", "quarter", "week", "doy", "dow", "isodow", "decade", "century", "epoch")
family("date_parts", "events", ["event_id"], {
    p: (lambda p=p: F.round(dates.date_part(p, c("ts")), 4), f"round(date_part('{p}', ts)::DOUBLE, 4)") for p in _EXTRACT
})
family("date_truncation", "events", ["event_id"], {
    u: (lambda u=u: dates.date_trunc(u, c("ts")).cast("timestamp_ntz"), f"date_trunc('{u}', ts)::TIMESTAMP") for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "decade")
} | {
    "bin": (lambda: dates.date_bin(15 * 60_000_000, c("ts"), "2001-01-01").cast("timestamp_ntz"), "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01')"),
    "ld": (lambda: f["last_day"](c("ts")), "last_day(ts)"),
    "dn": (lambda: f["dayname"](c("ts")), "dayname(ts)"),
    "mn": (lambda: f["monthname"](c("ts")), "monthname(ts)"),
    "txt": (lambda: f["to_char"](c("ts"), "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "mf": (lambda: f["date_format"](c("ts"), "%d/%m/%Y %H"), "strftime(ts, '%d/%m/%Y %H')"),
})
family("date_arithmetic", "orders", ["o_orderkey"], {
    "dd": (lambda: f["datediff"](c("o_orderdate"), F.lit("1996-01-01").cast("date")), "date_diff('day', TIMESTAMP '1996-01-01', o_orderdate)::INT"),
    "ad": (lambda: f["date_add"](c("o_orderdate"), 45).cast("timestamp_ntz"), "o_orderdate + INTERVAL 45 DAY"),
    "sb": (lambda: f["date_sub"](c("o_orderdate"), 2, "month").cast("timestamp_ntz"), "o_orderdate - INTERVAL 2 MONTH"),
    "td": (lambda: f["to_days"](c("o_orderdate")), "(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528)::INT"),
    "ut": (lambda: f["unix_timestamp"](c("o_orderdate")), "epoch(o_orderdate)::BIGINT"),
    "md": (lambda: f["make_date"](F.year("o_orderdate"), F.lit(2), F.lit(3)), "make_date(year(o_orderdate), 2, 3)"),
    "am": (lambda: dates.age(c("o_orderdate"), F.lit("1990-05-17"))["months"], "(date_part('year', age(o_orderdate, TIMESTAMP '1990-05-17')) * 12 + date_part('month', age(o_orderdate, TIMESTAMP '1990-05-17')))::INT"),
})
_LIST = "string_split(p_name, ' ')"
family("arrays", "part", ["p_partkey"], {
    "app": (lambda: F.array_join(f["array_append"](F.split("p_name", " "), "z"), ","), f"array_to_string(list_append({_LIST}, 'z'), ',')"),
    "pre": (lambda: F.array_join(f["array_prepend"]("z", F.split("p_name", " ")), ","), f"array_to_string(list_prepend('z', {_LIST}), ',')"),
    "cat": (lambda: F.array_join(f["array_cat"](F.split("p_name", " "), F.split("p_type", " ")), ","), f"array_to_string(list_concat({_LIST}, string_split(p_type, ' ')), ',')"),
    "len": (lambda: f["array_length"](F.split("p_name", " ")), f"len({_LIST})::INT"),
    "card": (lambda: f["cardinality"](F.split("p_name", " ")), f"len({_LIST})::INT"),
    "pos": (lambda: f["array_position"](F.split("p_name", " "), "part").cast("int"), f"list_position({_LIST}, 'part')::INT"),
    "rem": (lambda: F.array_join(f["array_remove"](F.split("p_name", " "), "part"), ","), f"array_to_string(list_filter({_LIST}, lambda x: x <> 'part'), ',')"),
    "repl": (lambda: F.array_join(f["array_replace"](F.split("p_name", " "), "part", "PART"), ","), f"array_to_string(list_transform({_LIST}, lambda x: CASE WHEN x = 'part' THEN 'PART' ELSE x END), ',')"),
    "rev": (lambda: F.array_join(f["array_reverse"](F.split("p_name", " ")), ","), f"array_to_string(list_reverse({_LIST}), ',')"),
    "srt": (lambda: F.array_join(f["array_sort"](F.split("p_name", " ")), ","), f"array_to_string(list_sort({_LIST}), ',')"),
    "txt": (lambda: f["array_to_string"](F.split("p_name", " "), "+"), f"array_to_string({_LIST}, '+')"),
    "sl": (lambda: F.array_join(arrays.slice_(F.split("p_name", " "), 1, 2), ","), f"array_to_string(({_LIST})[1:2], ',')"),
    "has": (lambda: arrays.contains(F.split("p_name", " "), F.array(F.lit("part"))), f"list_has_all({_LIST}, ['part'])"),
    "anyq": (lambda: arrays.any_of(c("p_size"), lambda a, b: a == b, F.array(F.lit(1), F.lit(7), F.lit(20))), "p_size = ANY ([1, 7, 20])"),
})
family("json", "events", ["event_id"], {
    "obj": (lambda: f["json_build_object"]("id", c("event_id"), "type", c("event_type")), "'{\"id\": ' || event_id || ', \"type\": \"' || event_type || '\"}'"),
    "arr": (lambda: f["json_build_array"](c("event_id"), c("event_type")), "'[' || event_id || ', \"' || event_type || '\"]'"),
    "ok": (lambda: f["json_valid"](c("props")), "json_valid(props)"),
    "ty": (lambda: f["json_typeof"](c("props")), "lower(json_type(props))"),
    "keys": (lambda: F.array_join(F.array_sort(f["json_object_keys"](c("props"))), ","), "array_to_string(list_sort(json_keys(props)), ',')"),
    "n": (lambda: f["json_length"](c("props")), "len(json_keys(props))::INT"),
})
family("json_documents", "conversations", ["conv_id", "turn"], {
    "doc": (lambda: json_docs.get_text(f["json_build_object"]("role", c("role"), "turn", c("turn")), "role"), "role"),
    "set": (lambda: f["jsonb_set"](f["json_build_object"]("a", c("turn")), F.array(F.lit("b")), "[1, 2]"), "'{\"a\": ' || turn || ', \"b\": [1, 2]}'"),
    "del": (lambda: f["jsonb_delete"](f["json_build_object"]("a", c("turn"), "b", c("role")), "b"), "'{\"a\": ' || turn || '}'"),
    "has": (lambda: f["jsonb_contains"](f["json_build_object"]("a", c("turn"), "b", c("role")), '{"b": "user"}'), "role = 'user'"),
    "path": (lambda: f["jsonb_path_exists"](f["json_build_object"]("a", c("turn")), "$.a ? (@ > 1)"), "turn > 1"),
    "merge": (lambda: f["json_merge_patch"](f["json_build_object"]("a", c("turn"), "b", 1), '{"b": null, "c": 2}'), "'{\"a\": ' || turn || ', \"c\": 2}'"),
})
family("ranges", "orders", ["o_orderkey"], {
    "has": (lambda: ranges.has(f["int8range"](c("o_custkey"), c("o_custkey") + 5), F.lit(20)), "o_custkey <= 20 AND 20 < o_custkey + 5"),
    "over": (lambda: ranges.overlap(f["int8range"](c("o_custkey"), c("o_custkey") + 5), f["int8range"](20, 30)), "o_custkey < 30 AND 20 < o_custkey + 5"),
    "left": (lambda: ranges.before(f["int8range"](c("o_custkey"), c("o_custkey") + 5), f["int8range"](20, 30)), "o_custkey + 5 <= 20"),
    "cut": (lambda: ranges.intersection(f["int8range"](c("o_custkey"), c("o_custkey") + 5), f["int8range"](20, 30))["lower"], "CASE WHEN o_custkey < 30 AND 20 < o_custkey + 5 THEN greatest(o_custkey, 20) END::BIGINT"),
    "merge": (lambda: f["range_merge"](f["int8range"](c("o_custkey"), c("o_custkey") + 5), f["int8range"](20, 30))["upper"], "greatest(o_custkey + 5, 30)::BIGINT"),
    "text": (lambda: ranges.show(f["int8range"](c("o_custkey"), c("o_custkey") + 5, "[]")), "'[' || o_custkey || ',' || (o_custkey + 6) || ')'"),
})
family("network", "supplier", ["s_suppkey"], {
    "ip": (lambda: f["inet_ntoa"](c("s_suppkey") + 3232235776), "'192.168.' || ((s_suppkey // 256) % 256 + 1) || '.' || (s_suppkey % 256)"),
    "back": (lambda: f["inet_aton"](f["inet_ntoa"](c("s_suppkey") + 3232235776)), "(s_suppkey + 3232235776)::BIGINT"),
    "net": (lambda: f["network"](F.concat(F.lit("10.1.2."), (c("s_suppkey") % 250).cast("string"), F.lit("/24"))), "'10.1.2.0/24'"),
    "host": (lambda: f["host"](F.concat(F.lit("10.1.2."), (c("s_suppkey") % 250).cast("string"), F.lit("/24"))), "'10.1.2.' || (s_suppkey % 250)"),
    "within": (lambda: network.FUNCTIONS["inet_contained"](F.concat(F.lit("10.1.2."), (c("s_suppkey") % 250).cast("string")), "10.1.2.0/25"), "s_suppkey % 250 < 128"),
})
family("geometry", "supplier", ["s_suppkey"], {
    "dist": (lambda: F.round(geometry.distance(geometry.point(c("s_suppkey"), 0), geometry.point(0, c("s_nationkey"))), 6), "round(sqrt(s_suppkey * s_suppkey + s_nationkey * s_nationkey), 6)"),
    "area": (lambda: f["area"](geometry.box(geometry.point(c("s_suppkey"), 2), geometry.point(0, 0))), "(s_suppkey * 2)::DOUBLE"),
    "inside": (lambda: geometry.circle_has(geometry.circle(geometry.point(0, 0), 10), geometry.point(c("s_suppkey"), c("s_nationkey"))), "sqrt(s_suppkey * s_suppkey + s_nationkey * s_nationkey) <= 10"),
    "flat": (lambda: f["ishorizontal"](geometry.lseg(geometry.point(0, c("s_nationkey")), geometry.point(1, 5))), "s_nationkey = 5"),
})
family("casts", "lineitem", ["l_orderkey", "l_linenumber"], {
    "i": (lambda: f["int4"](c("l_quantity") / 2), "round_even(l_quantity / 2, 0)::INT"),
    "b": (lambda: f["bool"](c("l_linenumber") - 1), "(l_linenumber - 1)::BOOLEAN"),
    "t": (lambda: f["text"](c("l_linenumber")), "l_linenumber::VARCHAR"),
    "d": (lambda: f["date"](c("l_shipdate")), "l_shipdate::DATE"),
    "v": (lambda: f["varchar"](c("l_returnflag"), 3), "left(l_returnflag, 3)"),
    "p": (lambda: f["character"](c("l_returnflag"), 3), "rpad(l_returnflag, 3, ' ')"),
    "e": (lambda: casts.enum_functions(["R", "A", "N"])["ordinal"](c("l_returnflag")), "list_position(['R', 'A', 'N'], l_returnflag)::INT"),
    "ty": (lambda: f["pg_typeof"](c("l_quantity")), "'double precision'"),
})
family("trigrams", "nation", ["n_nationkey"], {
    "same": (lambda: f["similarity"](c("n_name"), c("n_name")).cast("double"), "1.0::DOUBLE"),
    "n": (lambda: F.size(f["show_trgm"](c("n_name"))), "len(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(n_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))))::INT"),
})
family("full_text", "documents", ["doc_id"], {
    "the": (lambda: f["ts_match"](f["to_tsvector"]("simple", c("text")), "'the'"), "list_contains(string_split_regex(lower(text), '[^a-z]+'), 'the')"),
    "both": (lambda: f["ts_match"](f["to_tsvector"]("simple", c("text")), "'and' & 'the'"), "list_contains(string_split_regex(lower(text), '[^a-z]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^a-z]+'), 'and')"),
})
family("xml", "nation", ["n_nationkey"], {
    "el": (lambda: f["xmlelement"]("n", f["xmltext"](c("n_name")), k=c("n_nationkey").cast("string")), "'<n k=\"' || n_nationkey || '\">' || n_name || '</n>'"),
    "fo": (lambda: f["xmlforest"](a=c("n_name"), b=c("n_regionkey")), "'<a>' || n_name || '</a><b>' || n_regionkey || '</b>'"),
    "xp": (lambda: F.get(f["xpath"]("/n/text()", f["xmlelement"]("n", f["xmltext"](c("n_name")))), F.lit(0)), "n_name"),
})
family("uuid_and_hashes", "nation", ["n_nationkey"], {
    "u": (lambda: f["uuid"](f["md5"](c("n_name"))), "md5(n_name)[1:8] || '-' || md5(n_name)[9:12] || '-' || md5(n_name)[13:16] || '-' || md5(n_name)[17:20] || '-' || md5(n_name)[21:32]"),
    "is": (lambda: f["is_uuid"](f["uuid"](f["md5"](c("n_name")))), "true"),
    "back": (lambda: F.decode(f["from_base64"](f["to_base64"](c("n_name"))), "UTF-8"), "n_name"),
    "esc": (lambda: F.decode(f["decode"](f["encode"](F.encode(c("n_name"), "UTF-8"), "escape"), "escape"), "UTF-8"), "n_name"),
    "arm": (lambda: F.decode(f["dearmor"](f["armor"](F.encode(c("n_name"), "UTF-8"))), "UTF-8"), "n_name"),
})
