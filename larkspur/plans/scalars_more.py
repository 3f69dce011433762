"""More function families over columns: where DuckDB has no such function, its SQL states the known value or the law that holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import FUNCTIONS as f
from larkspur.functions import dates, ranges
from larkspur.functions.session_info import Sequence

from .scalars import ORACLE_SQL as _sql
from .scalars import QUERIES as _queries
from .scalars import family

_before = set(_queries)
c, lit = F.col, F.lit


def text(a):
    return F.array_join(a, "|")


family("string_changes", "nation", ["n_nationkey"], {
    "ini": (lambda: f["initcap"](F.lower(F.concat(c("n_name"), lit("-x y")))), "upper(left(n_name, 1)) || lower(substr(n_name, 2)) || '-X Y'"),
    "ovl": (lambda: f["overlay"](c("n_name"), "##", 2, 2), "left(n_name, 1) || '##' || substr(n_name, 4)"),
    "ins": (lambda: f["insert"](c("n_name"), 2, 2, "##"), "left(n_name, 1) || '##' || substr(n_name, 4)"),
    "mid": (lambda: f["mid"](c("n_name"), 2, 3), "substr(n_name, 2, 3)"),
    "sub": (lambda: f["substring"](c("n_name"), 2, 3), "substr(n_name, 2, 3)"),
    "pat": (lambda: f["substring"](c("n_name"), "^(..)"), "left(n_name, 2)"),
    "spc": (lambda: f["space"](3), "'   '"),
    "trm": (lambda: f["trim"](F.concat(lit("  "), c("n_name"), lit("  "))), "n_name"),
    "cat": (lambda: f["textcat"](c("n_name"), lit("!")), "n_name || '!'"),
    "oid": (lambda: f["nameconcatoid"](c("n_name"), c("n_nationkey")), "n_name || '_' || n_nationkey"),
    "idx": (lambda: f["substring_index"](F.concat(c("n_name"), lit(".b.c")), ".", 2), "n_name || '.b'"),
    "fmt": (lambda: f["format"]("%s-%s|%5s|%-5s|%%", c("n_name"), c("n_nationkey"), "ab", "cd"), "n_name || '-' || n_nationkey || '|   ab|cd   |%'"),
    "quo": (lambda: f["quote"](c("n_name")), "'''' || n_name || ''''"),
    "qid": (lambda: f["quote_ident"](F.concat(c("n_name"), lit(" x"))), "'\"' || n_name || ' x\"'"),
    "qnl": (lambda: f["quote_nullable"](F.nullif(c("n_name"), c("n_name"))), "'NULL'"),
    "fold": (lambda: f["casefold"](c("n_name")), "lower(n_name)"),
    "asc": (lambda: f["to_ascii"](F.concat(c("n_name"), lit("é"))), "n_name || 'e'"),
    "uni": (lambda: f["unistr"](F.concat(c("n_name"), lit(r"\0041"))), "n_name || 'A'"),
    "nrm": (lambda: f["normalize"](F.concat(c("n_name"), lit("é"))), "n_name || 'é'"),
    "isn": (lambda: f["is_normalized"](c("n_name")), "true"),
    "una": (lambda: f["unicode_assigned"](c("n_name")), "true"),
})
family("string_comparisons", "nation", ["n_nationkey"], {
    "cmp": (lambda: f["strcmp"](c("n_name"), "JAPAN"), "CASE WHEN n_name < 'JAPAN' THEN -1 WHEN n_name > 'JAPAN' THEN 1 ELSE 0 END"),
    "lt": (lambda: f["text_lt"](c("n_name"), "JAPAN"), "n_name < 'JAPAN'"),
    "le": (lambda: f["text_le"](c("n_name"), "JAPAN"), "n_name <= 'JAPAN'"),
    "gt": (lambda: f["text_gt"](c("n_name"), "JAPAN"), "n_name > 'JAPAN'"),
    "ge": (lambda: f["text_ge"](c("n_name"), "JAPAN"), "n_name >= 'JAPAN'"),
    "eq": (lambda: f["texteq"](c("n_name"), "JAPAN"), "n_name = 'JAPAN'"),
    "ne": (lambda: f["textne"](c("n_name"), "JAPAN"), "n_name <> 'JAPAN'"),
    "lg": (lambda: f["text_larger"](c("n_name"), "JAPAN"), "greatest(n_name, 'JAPAN')"),
    "sm": (lambda: f["text_smaller"](c("n_name"), "JAPAN"), "least(n_name, 'JAPAN')"),
    "bl": (lambda: f["bpchar_larger"](F.concat(c("n_name"), lit("  ")), "JAPAN "), "greatest(n_name, 'JAPAN')"),
    "bs": (lambda: f["bpchar_smaller"](c("n_name"), "JAPAN "), "least(n_name, 'JAPAN')"),
    "fld": (lambda: f["field"](c("n_regionkey"), 3, 1, 0), "CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 0 THEN 3 ELSE 0 END"),
    "elt": (lambda: f["elt"](c("n_regionkey"), "a", "b", "c"), "CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END"),
    "fis": (lambda: f["find_in_set"](c("n_regionkey").cast("string"), "4,2,0"), "CASE n_regionkey WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 0 THEN 3 ELSE 0 END"),
    "mks": (lambda: f["make_set"](c("n_regionkey"), "a", "b", "c"), "array_to_string(list_filter([CASE WHEN n_regionkey & 1 > 0 THEN 'a' END, CASE WHEN n_regionkey & 2 > 0 THEN 'b' END, CASE WHEN n_regionkey & 4 > 0 THEN 'c' END], lambda x: x IS NOT NULL), ',')"),
    "exs": (lambda: f["export_set"](c("n_regionkey"), "1", "0", "", 3), "reverse(lpad(to_binary(n_regionkey), 3, '0'))"),
    "ord": (lambda: f["ord"](c("n_name")), "ascii(n_name)::BIGINT"),
    "chr": (lambda: f["char"](c("n_nationkey") + 65, 66), "chr(n_nationkey + 65) || 'B'"),
    "ins": (lambda: f["instr"](c("n_name"), "A"), "strpos(n_name, 'A')::INT"),
    "loc": (lambda: f["locate"]("A", c("n_name"), 2), "CASE WHEN strpos(substr(n_name, 2), 'A') > 0 THEN strpos(substr(n_name, 2), 'A') + 1 ELSE 0 END::INT"),
    "lle": (lambda: f["levenshtein_less_equal"](c("n_name"), "NATION", 4), "least(levenshtein(n_name, 'NATION'), 5)::INT"),
    "dif": (lambda: f["difference"](c("n_name"), c("n_name")), "4"),
    "tsw": (lambda: f["text_starts_with"](c("n_name"), "A"), "starts_with(n_name, 'A')"),
    "tln": (lambda: f["textlen"](c("n_name")), "length(n_name)::INT"),
    "sim": (lambda: f["__similar_to"](c("n_name"), "%(A|N)"), "right(n_name, 1) IN ('A', 'N')"),
    "mid": (lambda: f["__substring_similar"](c("n_name"), '_#"%#"_', "#"), "substr(n_name, 2, length(n_name) - 2)"),
})
family("regular_expressions_more", "part", ["p_partkey"], {
    "m": (lambda: text(f["regexp_match"](c("p_name"), "([a-z]+) ([a-z0-9]+)")), "CASE WHEN regexp_matches(p_name, '([a-z]+) ([a-z0-9]+)') THEN array_to_string(regexp_extract_all(p_name, '([a-z]+) ([a-z0-9]+)', 1)[1:1] || regexp_extract_all(p_name, '([a-z]+) ([a-z0-9]+)', 2)[1:1], '|') END"),
    "all": (lambda: text(F.flatten(f["regexp_matches"](c("p_name"), "[0-9]", "g"))), "array_to_string(regexp_extract_all(p_name, '[0-9]'), '|')"),
    "at": (lambda: f["regexp_instr"](c("p_name"), "[0-9]"), "CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^[^0-9]*')) + 1 ELSE 0 END::INT"),
})
family("numbers_more", "part", ["p_partkey"], {
    **{n: (lambda n=n: F.round(f[n](c("p_size") / 51), 9), f"round(degrees({sql}), 9)") for n, sql in (("asind", "asin(p_size / 51)"), ("acosd", "acos(p_size / 51)"), ("atand", "atan(p_size / 51)"))},
    "atan2d": (lambda: F.round(f["atan2d"](c("p_size"), 10.0), 9), "round(degrees(atan2(p_size, 10)), 9)"),
    "tand": (lambda: F.round(f["tand"](c("p_size")), 9), "round(tan(radians(p_size)), 9)"),
    "cotd": (lambda: F.round(f["cotd"](c("p_size")), 8), "round(1 / tan(radians(p_size)), 8)"),
    "l10": (lambda: F.round(f["log10"](c("p_retailprice")), 9), "round(log10(p_retailprice), 9)"),
    "pow": (lambda: F.round(f["pow"](c("p_size"), 2), 4), "pow(p_size, 2)"),
    "ceil": (lambda: f["ceiling"](c("p_retailprice") / 3), "ceil(p_retailprice / 3)::BIGINT"),
    "tru": (lambda: f["truncate"](c("p_retailprice") / 3), "trunc(p_retailprice / 3)::BIGINT"),
    "pi": (lambda: f["pi"](), "pi()"),
    "ndt": (lambda: f["numeric_div_trunc"](c("p_partkey"), 7).cast("long"), "p_partkey // 7"),
    "bin": (lambda: f["bin"](c("p_size")), "to_binary(p_size)"),
    "oct": (lambda: f["oct"](c("p_size")), "CASE WHEN p_size < 8 THEN '' ELSE (p_size // 8)::VARCHAR END || (p_size % 8)"),
    "toct": (lambda: f["to_oct"](c("p_size")), "CASE WHEN p_size < 8 THEN '' ELSE (p_size // 8)::VARCHAR END || (p_size % 8)"),
    "hex": (lambda: f["hex"](c("p_size")), "upper(to_hex(p_size))"),
    "unh": (lambda: F.decode(f["unhex"](f["hex"](c("p_name"))), "UTF-8"), "p_name"),
    "conv": (lambda: f["conv"](c("p_size"), 10, 2), "to_binary(p_size)"),
    "bc": (lambda: f["bit_count"](c("p_size")), "bit_count(p_size)::INT"),
    "inc": (lambda: f["int8inc"](c("p_partkey")), "p_partkey + 1"),
    "dec": (lambda: f["int8dec"](c("p_partkey")), "p_partkey - 1"),
    "fin": (lambda: f["isfinite"](c("p_retailprice")), "isfinite(p_retailprice)"),
    "fac": (lambda: f["factorial"](c("p_size") % 15).cast("long"), "factorial((p_size % 15)::INT)::BIGINT"),
    "sca": (lambda: f["scale"](c("p_retailprice").cast("decimal(12,3)")), "3"),
    "msc": (lambda: f["min_scale"](c("p_size").cast("decimal(12,3)")), "0"),
    "tsc": (lambda: f["trim_scale"](c("p_size").cast("decimal(12,3)")).cast("long"), "p_size::BIGINT"),
    "nsq": (lambda: F.round(f["numeric_sqrt"](c("p_size").cast("decimal(12,0)")).cast("double"), 9), "round(sqrt(p_size), 9)"),
    "nex": (lambda: F.round(f["numeric_exp"]((c("p_size") / 100).cast("decimal(12,2)")).cast("double"), 9), "round(exp(p_size / 100), 9)"),
    "nln": (lambda: F.round(f["numeric_ln"](c("p_size").cast("decimal(12,0)")).cast("double"), 9), "round(ln(p_size), 9)"),
    "nlo": (lambda: F.round(f["numeric_log"](lit(2), c("p_size").cast("decimal(12,0)")).cast("double"), 9), "round(log2(p_size), 9)"),
    "erf": (lambda: F.round(f["erf"](c("p_size") / 50) + f["erfc"](c("p_size") / 50), 9), "1.0::DOUBLE"),
    "crc": (lambda: f["crc32"](c("p_name")) >= 0, "true"),
    "c3c": (lambda: f["crc32c"](lit("123456789")), "3808858755::BIGINT"),
    "rnd": (lambda: (f["random"]() < 1) & (f["rand"]() >= 0) & f["random_int"](lit(3), lit(5)).between(3, 5) & f["random_normal"](0.0, 1.0).isNotNull(), "true"),
})
family("pairs_by_type", "customer", ["c_custkey"], {
    **{f"{t}l": (lambda t=t: f[f"{t}larger"](c("c_nationkey"), 10), "greatest(c_nationkey, 10)") for t in ("int2", "int4", "int8", "oid")},
    **{f"{t}s": (lambda t=t: f[f"{t}smaller"](c("c_nationkey"), 10), "least(c_nationkey, 10)") for t in ("int2", "int4", "int8", "oid")},
    **{f"{t}l": (lambda t=t: f[f"{t}larger"](c("c_acctbal"), 10.0), "greatest(c_acctbal, 10::DOUBLE)") for t in ("float4", "float8", "cash")},
    **{f"{t}s": (lambda t=t: f[f"{t}smaller"](c("c_acctbal"), 10.0), "least(c_acctbal, 10::DOUBLE)") for t in ("float4", "float8", "cash")},
    "nl": (lambda: f["numeric_larger"](c("c_acctbal"), 10.0), "greatest(c_acctbal, 10::DOUBLE)"),
    "ns": (lambda: f["numeric_smaller"](c("c_acctbal"), 10.0), "least(c_acctbal, 10::DOUBLE)"),
    "ifn": (lambda: f["ifnull"](F.nullif(c("c_nationkey"), lit(3)), -1), "ifnull(nullif(c_nationkey, 3), -1)"),
    "isn": (lambda: f["isnull"](F.nullif(c("c_nationkey"), lit(3))), "c_nationkey = 3"),
    "nnn": (lambda: f["num_nonnulls"](F.nullif(c("c_nationkey"), lit(3)), c("c_name")), "2 - (c_nationkey = 3)::INT"),
    "piv": (lambda: f["pg_input_is_valid"](c("c_name"), "integer"), "false"),
    "isj": (lambda: f["pg_is_json"](c("c_custkey").cast("string")), "true"),
    "row": (lambda: f["row"](c("c_custkey"), c("c_name"))["f2"], "c_name"),
    "eon": (lambda: f["error_on_null"](c("c_name")), "c_name"),
    "nc": (lambda: f["name_const"]("x", 4), "4"),
})
_T = "timestamp_ntz"
family("mysql_dates", "events", ["event_id"], {
    **{n: (lambda n=n: f[n](c("ts")), f"{n}(ts)::INT") for n in ("year", "month", "day", "hour", "minute", "second", "quarter", "dayofmonth", "dayofyear", "weekofyear")},
    "dw": (lambda: f["dayofweek"](c("ts")), "dayofweek(ts)::INT + 1"),
    "wd": (lambda: f["weekday"](c("ts")), "isodow(ts)::INT - 1"),
    "us": (lambda: f["microsecond"](c("ts")), "(microsecond(ts) % 1000000)::INT"),
    "wk": (lambda: f["week"](c("ts"), 3), "weekofyear(ts)::INT"),
    "yw": (lambda: f["yearweek"](c("ts"), 3), "yearweek(ts)::INT"),
    "fd": (lambda: f["from_days"](f["to_days"](c("ts"))), "ts::DATE"),
    "ts": (lambda: f["to_seconds"](c("ts")), "(date_diff('day', DATE '1970-01-01', ts::DATE) + 719528) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"),
    "tt": (lambda: f["time_to_sec"](c("ts")), "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT"),
    "fu": (lambda: f["from_unixtime"](F.unix_seconds(c("ts").cast("timestamp"))).cast(_T), "date_trunc('second', ts)"),
    "aa": (lambda: f["adddate"](c("ts"), 3).cast(_T), "ts + INTERVAL 3 DAY"),
    "sa": (lambda: f["subdate"](c("ts"), 3).cast(_T), "ts - INTERVAL 3 DAY"),
    "ds": (lambda: f["date_subtract"](c("ts"), 3, "hour").cast(_T), "ts - INTERVAL 3 HOUR"),
    "at": (lambda: f["addtime"](c("ts"), "01:30:00").cast(_T), "ts + INTERVAL 90 MINUTE"),
    "st": (lambda: f["subtime"](c("ts"), "01:30:00").cast(_T), "ts - INTERVAL 90 MINUTE"),
    "ta": (lambda: f["timestampadd"]("hour", 5, c("ts").cast("timestamp")).cast(_T), "ts + INTERVAL 5 HOUR"),
    "tf": (lambda: f["time_format"](c("ts"), "%H-%i"), "strftime(ts, '%H-%M')"),
    "sd": (lambda: f["str_to_date"](f["date_format"](c("ts"), "%Y/%m/%d %H:%i"), "%Y/%m/%d %H:%i").cast(_T), "date_trunc('minute', ts)"),
    "ct": (lambda: f["convert_tz"](c("ts"), "UTC", "Asia/Kolkata"), "ts + INTERVAL 330 MINUTE"),
    "md": (lambda: f["makedate"](F.year("ts"), F.dayofyear("ts")), "ts::DATE"),
    "pa": (lambda: f["period_add"](F.year("ts") * 100 + F.month("ts"), lit(1)), "strftime(ts + INTERVAL 1 MONTH, '%Y%m')::INT"),
    "pd": (lambda: f["period_diff"](F.year("ts") * 100 + F.month("ts"), lit(200001)), "((year(ts) - 2000) * 12 + month(ts) - 1)::INT"),
    "gf": (lambda: f["get_format"]("DATE", "ISO"), "'%Y-%m-%d'"),
})
family("times_and_intervals", "events", ["event_id"], {
    "td": (lambda: f["to_date"](f["to_char"](c("ts"), "DD/MM/YYYY"), "DD/MM/YYYY"), "ts::DATE"),
    "tt": (lambda: f["to_timestamp"](f["to_char"](c("ts"), "YYYY-MM-DD HH24:MI:SS"), "YYYY-MM-DD HH24:MI:SS").cast(_T), "date_trunc('second', ts)"),
    "ep": (lambda: f["to_timestamp"](F.unix_seconds(c("ts").cast("timestamp"))).cast(_T), "date_trunc('second', ts)"),
    "tn": (lambda: f["to_number"](F.format_number("value", 2), "999,999.99").cast("double"), "round(value, 2)"),
    "mt": (lambda: f["make_time"](F.hour("ts"), F.minute("ts"), F.second("ts")), "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT * 1000000"),
    "ms": (lambda: f["make_timestamp"](F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), F.minute("ts"), F.second("ts").cast("decimal(16,6)")), "date_trunc('second', ts)"),
    "mz": (lambda: f["make_timestamptz"](F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), F.minute("ts"), F.second("ts").cast("decimal(16,6)")).cast(_T), "date_trunc('second', ts)"),
    "jd": (lambda: f["justify_days"](f["make_interval"](days=F.day("ts") + 30))["months"], "((day(ts) + 30) // 30)::INT"),
    "jh": (lambda: f["justify_hours"](f["make_interval"](hours=F.hour("ts") + 30))["days"], "((hour(ts) + 30) // 24)::INT"),
    "ji": (lambda: f["justify_interval"](f["make_interval"](days=F.day("ts") + 30, hours=30))["days"], "((day(ts) + 31) % 30)::INT"),
    "il": (lambda: f["interval_larger"](f["make_interval"](days=F.day("ts")), f["make_interval"](days=15))["days"], "greatest(day(ts), 15)::INT"),
    "is": (lambda: f["interval_smaller"](f["make_interval"](days=F.day("ts")), f["make_interval"](days=15))["days"], "least(day(ts), 15)::INT"),
    "dl": (lambda: f["date_larger"](F.to_date("ts"), lit("2024-01-15").cast("date")), "greatest(ts::DATE, DATE '2024-01-15')"),
    "dm": (lambda: f["date_smaller"](F.to_date("ts"), lit("2024-01-15").cast("date")), "least(ts::DATE, DATE '2024-01-15')"),
    "tl": (lambda: f["timestamp_larger"](c("ts"), lit("2024-01-15").cast(_T)), "greatest(ts, TIMESTAMP '2024-01-15')"),
    "tm": (lambda: f["timestamp_smaller"](c("ts"), lit("2024-01-15").cast(_T)), "least(ts, TIMESTAMP '2024-01-15')"),
    "di": (lambda: f["timestampdiff"]("day", lit("2020-01-01").cast("timestamp"), c("ts").cast("timestamp")), "date_diff('day', TIMESTAMP '2020-01-01', ts)"),
    "du": (lambda: F.unix_micros(lit("1970-01-01").cast("timestamp") + f["timediff"](c("ts"), F.date_trunc("day", "ts"))), "date_diff('microsecond', date_trunc('day', ts), ts)"),
    "ov": (lambda: f["overlaps"](c("ts"), dates.shift(c("ts"), days=3), F.date_trunc("month", "ts"), dates.shift(F.date_trunc("month", "ts"), days=5)), "day(ts) <= 5"),
    "sh": (lambda: dates.shift(c("ts"), months=1, micros=5).cast(_T), "ts + INTERVAL 1 MONTH + INTERVAL 5 MICROSECOND"),
})
_A = "[n_nationkey, n_regionkey, 7]"
family("arrays_more", "nation", ["n_nationkey"], {
    "up": (lambda: f["array_upper"](F.array("n_nationkey", "n_regionkey", lit(7))), "3"),
    "lo": (lambda: f["array_lower"](F.array("n_nationkey")), "1"),
    "nd": (lambda: f["array_ndims"](F.array(F.array("n_nationkey"))), "2"),
    "di": (lambda: f["array_dims"](F.array("n_nationkey", "n_regionkey")), "'[1:2]'"),
    "ps": (lambda: text(F.transform(f["array_positions"](F.array("n_nationkey", "n_regionkey", lit(7)), 7), lambda x: x.cast("string"))), f"array_to_string(list_filter([1, 2, 3], lambda i: ({_A})[i] = 7), '|')"),
    "fi": (lambda: text(F.transform(f["array_fill"](c("n_regionkey"), [3]), lambda x: x.cast("string"))), "array_to_string([n_regionkey, n_regionkey, n_regionkey], '|')"),
    "tr": (lambda: F.size(f["trim_array"](F.array("n_nationkey", "n_regionkey", lit(7)), 2)), "1"),
    "as": (lambda: F.element_at(f["__array_assign"](F.array("n_nationkey", "n_regionkey"), 2, 99), 2), "99"),
    "sl": (lambda: text(F.transform(f["__array_assign_slice"](F.array("n_nationkey", "n_regionkey", lit(7)), 1, 2, F.array(lit(8), lit(9))), lambda x: x.cast("string"))), "'8|9|7'"),
    "sh": (lambda: F.size(f["array_shuffle"](F.array("n_nationkey", "n_regionkey"))) + F.size(f["array_sample"](F.array("n_nationkey", "n_regionkey"), 1)), "3"),
})
_J = lambda: f["json_build_object"]("a", c("n_nationkey"), "b", F.array("n_regionkey", lit(7)), "s", c("n_name"))
_ARR = "'[' || n_regionkey || ', 7]'"
_OBJ = "'{\"a\": ' || n_nationkey || ', \"b\": [' || n_regionkey || ', 7], \"s\": \"' || n_name || '\"}'"
family("json_reading", "nation", ["n_nationkey"], {
    "can": (lambda: f["jsonb"](_J()), _OBJ),
    "ser": (lambda: f["jsonb"](f["json_serialize"](_J())), _OBJ),
    "el": (lambda: f["json_array_element"](f["json_object_field"](_J(), "b"), 1), "'7'"),
    "elt": (lambda: f["jsonb_array_element_text"](f["jsonb_object_field"](_J(), "b"), 0), "n_regionkey::VARCHAR"),
    "fld": (lambda: f["json_object_field_text"](_J(), "s"), "n_name"),
    "pth": (lambda: f["json_extract_path"](_J(), "b", "1"), "'7'"),
    "ptt": (lambda: f["jsonb_extract_path_text"](_J(), "s"), "n_name"),
    "len": (lambda: f["jsonb_array_length"](f["json_object_field"](_J(), "b")), "2"),
    "jln": (lambda: f["json_array_length"](f["json_object_field"](_J(), "b")), "2"),
    "dep": (lambda: f["json_depth"](_J()), "3"),
    "key": (lambda: f["json_keys"](_J()), "'[\"a\",\"b\",\"s\"]'"),
    "els": (lambda: text(f["json_array_elements_text"](f["json_object_field"](_J(), "b"))), "n_regionkey || '|7'"),
    "ele": (lambda: text(f["json_array_elements"](f["json_object_field"](_J(), "b"))), "n_regionkey || '|7'"),
    "bel": (lambda: text(f["jsonb_array_elements_text"](f["json_object_field"](_J(), "b"))), "n_regionkey || '|7'"),
    "ech": (lambda: F.size(f["json_each"](_J())) + F.size(f["jsonb_each"](_J())) + F.size(f["jsonb_each_text"](_J())), "9"),
    "ext": (lambda: f["json_extract"](_J(), "$.b[1]"), "'7'"),
    "val": (lambda: f["json_value"](_J(), "$.s"), "n_name"),
    "typ": (lambda: f["json_type"](_J()), "'OBJECT'"),
    "tyo": (lambda: f["jsonb_typeof"](f["json_object_field"](_J(), "b")), "'array'"),
    "ex": (lambda: f["jsonb_exists"](_J(), "a"), "true"),
    "exa": (lambda: f["jsonb_exists_any"](_J(), F.array(lit("z"), lit("s"))), "true"),
    "exl": (lambda: f["jsonb_exists_all"](_J(), F.array(lit("z"), lit("s"))), "false"),
    "con": (lambda: f["json_contains"](_J(), '{"b": [7]}'), "true"),
    "ctd": (lambda: f["jsonb_contained"]('{"s": "JAPAN"}', _J()), "n_name = 'JAPAN'"),
    "cp": (lambda: f["json_contains_path"](_J(), "all", "$.a", "$.z"), "false"),
    "ovl": (lambda: f["json_overlaps"](f["json_object_field"](_J(), "b"), "[3, 9]"), "n_regionkey = 3"),
    "sea": (lambda: f["json_search"](_J(), "one", c("n_name")), "'\"$.s\"'"),
    "siz": (lambda: f["json_storage_size"](_J()), f"strlen({_OBJ})::INT - 1"),
    "jpe": (lambda: f["json_path_exists"](_J(), '$.s ? (@ starts with "A")'), "n_name LIKE 'A%'"),
    "jpm": (lambda: f["jsonb_path_match"](_J(), "$.b[0] > 2"), "n_regionkey > 2"),
    "mat": (lambda: f["json_path_match"](_J(), "$.a < 5"), "n_nationkey < 5"),
    "jpq": (lambda: text(f["json_path_query"](_J(), "$.b[*]")), "n_regionkey || '|7'"),
    "jpa": (lambda: f["jsonb_path_query_array"](_J(), "$.b[*]"), _ARR),
    "jqa": (lambda: f["json_path_query_array"](_J(), "$.b.size()"), "'[2]'"),
    "jpf": (lambda: f["jsonb_path_query_first"](_J(), "$.b[last]"), "'7'"),
    "jqf": (lambda: f["json_path_query_first"](_J(), "$.a * 2"), "(n_nationkey * 2)::VARCHAR"),
    "rec": (lambda: f["jsonb_to_record"](_J(), "a int")["a"], "n_nationkey"),
    "rcs": (lambda: F.size(f["json_to_recordset"]('[{"x":1},{"x":2}]', "x int")) + F.size(f["jsonb_to_recordset"]('[{"x":1}]', "x int")), "3"),
    "pop": (lambda: f["json_populate_record"](None, _J(), "s string")["s"], "n_name"),
    "pob": (lambda: f["jsonb_populate_record"](None, _J(), "s string")["s"], "n_name"),
})
family("json_writing", "nation", ["n_nationkey"], {
    "tj": (lambda: f["to_json"](c("n_name")), "'\"' || n_name || '\"'"),
    "tb": (lambda: f["to_jsonb"](F.array("n_regionkey", lit(7))), _ARR),
    "rj": (lambda: f["row_to_json"](F.struct("n_nationkey", "n_name")), "'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'"),
    "rb": (lambda: f["row_to_jsonb"](F.struct(c("n_nationkey").alias("k"))), "'{\"k\": ' || n_nationkey || '}'"),
    "aj": (lambda: f["array_to_json"](F.array("n_regionkey", lit(7))), "'[' || n_regionkey || ',7]'"),
    "bo": (lambda: f["jsonb_build_object"]("k", c("n_nationkey")), "'{\"k\": ' || n_nationkey || '}'"),
    "ba": (lambda: f["jsonb_build_array"](c("n_regionkey"), 7), _ARR),
    "ja": (lambda: f["json_array"](c("n_regionkey"), 7), _ARR),
    "jo": (lambda: f["json_object"](F.array(lit("k"), c("n_name"))), "'{\"k\":\"' || n_name || '\"}'"),
    "jb": (lambda: f["jsonb_object"](F.array(lit("k")), F.array(c("n_name"))), "'{\"k\":\"' || n_name || '\"}'"),
    "js": (lambda: f["json_scalar"](c("n_nationkey")), "n_nationkey::VARCHAR"),
    "qt": (lambda: f["json_unquote"](f["json_quote"](c("n_name"))), "n_name"),
    "id": (lambda: f["json"](c("n_name")), "n_name"),
    "se": (lambda: f["json_set"]('{"k": 1}', "$.k", c("n_nationkey").cast("string")), "'{\"k\": ' || n_nationkey || '}'"),
    "in": (lambda: f["json_insert"]('{"k": 1}', "$.n", c("n_nationkey").cast("string")), "'{\"k\": 1, \"n\": ' || n_nationkey || '}'"),
    "re": (lambda: f["json_replace"]('{"k": 1}', "$.n", c("n_nationkey").cast("string")), "'{\"k\": 1}'"),
    "rm": (lambda: f["json_remove"](_J(), "$.b", "$.s"), "'{\"a\": ' || n_nationkey || '}'"),
    "ap": (lambda: f["json_array_append"](f["json_object_field"](_J(), "b"), "$", "1"), "'[' || n_regionkey || ', 7, 1]'"),
    "ai": (lambda: f["json_array_insert"](f["json_object_field"](_J(), "b"), "$[0]", "1"), "'[1, ' || n_regionkey || ', 7]'"),
    "bi": (lambda: f["jsonb_insert"]('{"a": [1]}', F.array(lit("a"), lit("0")), c("n_nationkey").cast("string")), "'{\"a\": [' || n_nationkey || ', 1]}'"),
    "sl": (lambda: f["jsonb_set_lax"](_J(), F.array(lit("a")), F.nullif(lit("1"), lit("1")), True, "delete_key"), "'{\"b\": [' || n_regionkey || ', 7], \"s\": \"' || n_name || '\"}'"),
    "dl": (lambda: f["json_delete"](f["json_object_field"](_J(), "b"), 0), "'[7]'"),
    "dp": (lambda: f["jsonb_delete_path"](_J(), F.array(lit("b"), lit("0"))), "'{\"a\": ' || n_nationkey || ', \"b\": [7], \"s\": \"' || n_name || '\"}'"),
    "jd": (lambda: f["json_delete_path"](_J(), F.array(lit("s"))), "'{\"a\": ' || n_nationkey || ', \"b\": [' || n_regionkey || ', 7]}'"),
    "cc": (lambda: f["jsonb_concat"]('{"x": 1}', f["jsonb_build_object"]("k", c("n_nationkey"))), "'{\"k\": ' || n_nationkey || ', \"x\": 1}'"),
    "jc": (lambda: f["json_concat"]("[1]", f["json_build_array"](c("n_nationkey"))), "'[1, ' || n_nationkey || ']'"),
    "me": (lambda: f["json_merge"]('{"k": 1}', f["jsonb_build_object"]("k", c("n_nationkey"))), "'{\"k\": [1, ' || n_nationkey || ']}'"),
    "mp": (lambda: f["json_merge_preserve"]("[1]", f["json_build_array"](c("n_nationkey"))), "'[1, ' || n_nationkey || ']'"),
    "sn": (lambda: f["jsonb_strip_nulls"](f["jsonb_build_object"]("k", c("n_nationkey"), "z", F.nullif(lit(1), lit(1)))), "'{\"k\": ' || n_nationkey || '}'"),
    "jn": (lambda: f["json_strip_nulls"]('{"a": null}'), "'{}'"),
    "pp": (lambda: f["jsonb"](f["jsonb_pretty"](_J())), _OBJ),
    "pj": (lambda: f["json_pretty"](f["json_build_array"](c("n_nationkey"))), "'[' || chr(10) || '    ' || n_nationkey || chr(10) || ']'"),
})
_B = lambda: F.encode(c("n_name"), "UTF-8")
family("bytes_and_digests", "nation", ["n_nationkey"], {
    "sha": (lambda: f["sha"](c("n_name")), "sha1(n_name)"),
    "sh1": (lambda: f["sha1"](c("n_name")), "sha1(n_name)"),
    "sh2": (lambda: f["sha2"](c("n_name"), 256), "sha256(n_name)"),
    "dig": (lambda: F.lower(F.hex(f["digest"](c("n_name"), "sha256"))), "sha256(n_name)"),
    "s22": (lambda: F.length(f["sha224"](c("n_name"))) + F.length(f["sha384"](c("n_name"))) + F.length(f["sha512"](c("n_name"))), "140"),
    "mac": (lambda: F.length(f["hmac"](c("n_name"), "key", "sha256")), "32"),
    "cvf": (lambda: f["convert_from"](f["convert_to"](c("n_name"), "UTF-16"), "UTF-16"), "n_name"),
    "cnv": (lambda: F.decode(f["convert"](_B(), "UTF-8", "US-ASCII"), "US-ASCII"), "n_name"),
    "gby": (lambda: f["get_byte"](_B(), lit(0)), "ascii(n_name)"),
    "gbt": (lambda: f["get_bit"](_B(), 0), "ascii(n_name) & 1"),
    "sby": (lambda: F.decode(f["set_byte"](_B(), 0, 88), "UTF-8"), "'X' || substr(n_name, 2)"),
    "sbt": (lambda: f["get_bit"](f["set_bit"](_B(), 3, 1), 3), "1"),
    "cat": (lambda: F.decode(f["byteacat"](_B(), _B()), "UTF-8"), "n_name || n_name"),
    "xor": (lambda: F.hex(f["bytea_xor"](_B(), _B())), "repeat('00', length(n_name))"),
    "xo2": (lambda: F.hex(f["byteaxor"](_B(), _B())), "repeat('00', length(n_name))"),
    "and": (lambda: F.decode(f["bytea_and"](_B(), _B()), "UTF-8"), "n_name"),
    "or": (lambda: F.decode(f["bytea_or"](_B(), _B()), "UTF-8"), "n_name"),
    "lrg": (lambda: F.decode(f["bytea_larger"](_B(), F.encode(lit("JAPAN"), "UTF-8")), "UTF-8"), "greatest(n_name, 'JAPAN')"),
    "sml": (lambda: F.decode(f["bytea_smaller"](_B(), F.encode(lit("JAPAN"), "UTF-8")), "UTF-8"), "least(n_name, 'JAPAN')"),
    "rnd": (lambda: F.length(f["gen_random_bytes"](8)) + F.length(f["random_bytes"](4)), "12"),
    "cry": (lambda: f["crypt"](c("n_name"), "$1$abcdefgh$") == f["crypt"](c("n_name"), f["crypt"](c("n_name"), "$1$abcdefgh$")), "true"),
    "slt": (lambda: F.length(f["gen_salt"]("md5")), "11"),
    "hsh": (lambda: (f["hashint4"](c("n_nationkey")) == f["hashint8"](c("n_nationkey").cast("long"))) & (f["hashint2"](c("n_nationkey")) == f["hashint4"](c("n_nationkey"))) & (f["hashtext"](c("n_name")) == f["hashbytea"](_B())), "true"),
    "uu4": (lambda: f["uuid_extract_version"](f["gen_random_uuid"]()) + f["uuid_extract_version"](f["uuid_generate_v4"]()), "8"),
    "uu7": (lambda: f["uuid_extract_version"](f["uuid_generate_v7"]()) + f["uuid_extract_version"](f["gen_uuid_v7"]()), "14"),
    "ut7": (lambda: f["uuid_extract_timestamp"](f["uuidv7"]()) > lit("2020-01-01").cast("timestamp"), "true"),
    "uu5": (lambda: f["uuid_extract_version"](f["uuid_generate_v5"](f["uuid_nil"](), c("n_name"))) + f["uuid_extract_version"](f["uuid_generate_v3"](f["uuid_nil"](), c("n_name"))), "8"),
    "ush": (lambda: f["uuid_short"]() >= 0, "true"),
})
_V = lambda: f["to_tsvector"]("simple", F.concat(c("n_name"), lit(" the end and the start")))
family("text_search_more", "nation", ["n_nationkey"], {
    "len": (lambda: f["tsvector_length"](_V()), "6"),
    "arr": (lambda: F.array_contains(f["tsvector_to_array"](_V()), "start"), "true"),
    "del": (lambda: F.array_contains(f["tsvector_to_array"](f["ts_delete"](_V(), "start")), "start"), "false"),
    "wgt": (lambda: F.element_at(F.element_at(f["setweight"](_V(), "B"), 1)["weights"], 1), "'B'"),
    "flt": (lambda: F.size(f["ts_filter"](f["setweight"](_V(), "B"), "a")), "0"),
    "stp": (lambda: F.size(F.element_at(f["strip"](_V()), 1)["positions"]), "0"),
    "att": (lambda: F.size(f["array_to_tsvector"](F.array(lit("b"), lit("a"), lit("b")))), "2"),
    "ttq": (lambda: f["to_tsquery"]("english", F.concat(lit("running & "), lit("dogs"))), "'''run'' & ''dog'''"),
    "ptq": (lambda: f["plainto_tsquery"]("english", "The running dogs"), "'''run'' & ''dog'''"),
    "phq": (lambda: f["phraseto_tsquery"]("english", "running dogs"), "'''run'' <-> ''dog'''"),
    "web": (lambda: f["websearch_to_tsquery"]("english", "dogs or -cats"), "'''dog'' | !''cat'''"),
    "rnk": (lambda: f["ts_rank"](_V(), "'end' & 'start'") > 0, "true"),
    "rcd": (lambda: f["ts_rank_cd"](_V(), "'missing'").cast("double"), "0.0::DOUBLE"),
    "hdl": (lambda: f["ts_headline"]("simple", F.concat(lit("a "), F.lower("n_name")), "'nation'"), "'a <b>nation</b>' || substr(lower(n_name), 7)"),
    "lex": (lambda: F.array_join(f["ts_lexize"]("english_stem", "connections"), ","), "'connect'"),
    "nod": (lambda: f["numnode"]("'a' & !'b'"), "4"),
    "tre": (lambda: f["querytree"]("'a' & 'b'"), "'''a'' & ''b'''"),
    "rew": (lambda: f["ts_rewrite"]("'a' & 'b'", "'a'", "'c'"), "'''c'' & ''b'''"),
    "and": (lambda: f["tsquery_and"]("'a'", "'b'"), "'''a'' & ''b'''"),
    "or": (lambda: f["tsquery_or"]("'a'", "'b'"), "'''a'' | ''b'''"),
    "not": (lambda: f["tsquery_not"]("'a'"), "'!''a'''"),
    "phr": (lambda: f["tsquery_phrase"]("'a'", "'b'", 3), "'''a'' <3> ''b'''"),
    "cfg": (lambda: f["get_current_ts_config"](), "'english'"),
    "jtv": (lambda: F.size(f["jsonb_to_tsvector"]("simple", '{"a": "x y"}')) + F.size(f["json_to_tsvector"]("simple", '{"a": "x y"}')), "4"),
    "dbg": (lambda: F.element_at(f["ts_debug"]("english", "cats"), 1)["alias"], "'asciiword'"),
    "lit": (lambda: F.size(f["tsvector"]("'a':1 'b':2A")), "2"),
    "qry": (lambda: f["tsquery"]("a & b"), "'''a'' & ''b'''"),
})
family("trigrams_more", "nation", ["n_nationkey"], {
    "dst": (lambda: f["similarity_dist"](c("n_name"), c("n_name")).cast("double"), "0.0::DOUBLE"),
    "op": (lambda: f["similarity_op"](c("n_name"), c("n_name")), "true"),
    "wrd": (lambda: f["word_similarity"](c("n_name"), F.concat(lit("x "), c("n_name"), lit(" y"))).cast("double"), "1.0::DOUBLE"),
    "str": (lambda: f["strict_word_similarity"](c("n_name"), F.concat(lit("x "), c("n_name"), lit(" y"))).cast("double"), "1.0::DOUBLE"),
    "wop": (lambda: f["word_similarity_op"](c("n_name"), c("n_name")) & f["strict_word_similarity_op"](c("n_name"), c("n_name")), "true"),
    "com": (lambda: f["word_similarity_commutator_op"](c("n_name"), c("n_name")) & f["strict_word_similarity_commutator_op"](c("n_name"), c("n_name")), "true"),
    "wds": (lambda: (f["word_similarity_dist_op"](c("n_name"), c("n_name")) + f["strict_word_similarity_dist_op"](c("n_name"), c("n_name")) + f["word_similarity_dist_commutator_op"](c("n_name"), c("n_name")) + f["strict_word_similarity_dist_commutator_op"](c("n_name"), c("n_name"))).cast("double"), "0.0::DOUBLE"),
    "lim": (lambda: F.round(f["show_limit"]().cast("double"), 4), "0.3::DOUBLE"),
})
_R = lambda: f["int4range"](c("n_nationkey"), c("n_nationkey") + c("n_regionkey"))
family("ranges_more", "nation", ["n_nationkey"], {
    "emp": (lambda: f["isempty"](_R()), "n_regionkey = 0"),
    "lin": (lambda: f["lower_inc"](_R()), "n_regionkey > 0"),
    "uin": (lambda: f["upper_inc"](_R()), "false"),
    "lif": (lambda: f["lower_inf"](f["int4range"](None, c("n_nationkey"))), "true"),
    "uif": (lambda: f["upper_inf"](f["int4range"](c("n_nationkey"), None)), "true"),
    "adj": (lambda: f["range_adjacent"](_R(), f["int4range"](c("n_nationkey") + c("n_regionkey"), 100)), "n_regionkey > 0"),
    "num": (lambda: ranges.has(f["numrange"](0, c("n_regionkey")), lit(2.5)), "n_regionkey > 2.5"),
    "dat": (lambda: ranges.has(f["daterange"](lit("2024-01-01"), lit("2024-02-01")), F.date_add(lit("2024-01-20").cast("date"), c("n_nationkey"))), "n_nationkey < 12"),
    "tsr": (lambda: ranges.overlap(f["tsrange"](lit("2024-01-01"), lit("2024-02-01")), f["tsrange"](F.date_add(lit("2024-01-20").cast("date"), c("n_nationkey")), lit("2025-01-01"))), "n_nationkey < 12"),
    "tzr": (lambda: f["isempty"](f["tstzrange"](lit("2024-01-01"), lit("2024-01-01"))), "true"),
    "mul": (lambda: text(F.transform(f["int4multirange"](_R(), f["int4range"](50, 60)), ranges.show)), "CASE WHEN n_regionkey = 0 THEN '[50,60)' ELSE '[' || n_nationkey || ',' || (n_nationkey + n_regionkey) || ')|[50,60)' END"),
    "uni": (lambda: F.size(ranges.multi_union(f["int8multirange"](f["int8range"](1, 3)), f["multirange"](f["int8range"](2, 9)))), "1"),
    "nmr": (lambda: F.size(f["nummultirange"](f["numrange"](1, 2), f["numrange"](5, 6))) + F.size(f["datemultirange"](f["daterange"](lit("2024-01-01"), lit("2024-02-01")))) + F.size(f["tsmultirange"](f["tsrange"](lit("2024-01-01"), lit("2024-02-01")))) + F.size(f["tstzmultirange"](f["tstzrange"](lit("2024-01-01"), lit("2024-02-01")))), "5"),
    "txt": (lambda: ranges.show(ranges.read(F.format_string("[%d,%d]", c("n_nationkey"), c("n_nationkey") + 2), "int")), "'[' || n_nationkey || ',' || (n_nationkey + 3) || ')'"),
})
_IP = lambda: F.concat(lit("10.0."), c("n_regionkey").cast("string"), lit("."), c("n_nationkey").cast("string"), lit("/24"))
family("network_more", "nation", ["n_nationkey"], {
    "bro": (lambda: f["broadcast"](_IP()), "'10.0.' || n_regionkey || '.255/24'"),
    "msk": (lambda: f["netmask"](_IP()), "'255.255.255.0'"),
    "hmk": (lambda: f["hostmask"](_IP()), "'0.0.0.255'"),
    "len": (lambda: f["masklen"](_IP()), "24"),
    "set": (lambda: f["set_masklen"](_IP(), 16), "'10.0.' || n_regionkey || '.' || n_nationkey || '/16'"),
    "abb": (lambda: f["abbrev"](_IP()), "'10.0.' || n_regionkey || '.' || n_nationkey || '/24'"),
    "cab": (lambda: f["cidr_abbrev"](F.concat(lit("10."), c("n_nationkey").cast("string"), lit(".0.0/16"))), "'10.' || n_nationkey || '/16'"),
    "fam": (lambda: f["family"](_IP()) + f["family"]("::1"), "10"),
    "mrg": (lambda: f["inet_merge"](_IP(), f["host"](_IP())), "'10.0.' || n_regionkey || '.0/24'"),
    "sam": (lambda: f["inet_same_family"](_IP(), "::1"), "false"),
    "lrg": (lambda: f["network_larger"](f["host"](_IP()), "9.0.0.1"), "'10.0.' || n_regionkey || '.' || n_nationkey"),
    "sml": (lambda: f["network_smaller"](f["host"](_IP()), "9.0.0.1"), "'9.0.0.1'"),
    "v4": (lambda: f["is_ipv4"](f["host"](_IP())), "true"),
    "v6": (lambda: f["is_ipv6"](f["host"](_IP())), "false"),
    "nto": (lambda: f["inet6_ntoa"](f["inet6_aton"](f["host"](_IP()))), "'10.0.' || n_regionkey || '.' || n_nationkey"),
    "cne": (lambda: f["inet_contained_eq"](_IP(), f["network"](_IP())) & f["inet_contains_eq"](f["network"](_IP()), _IP()) & f["inet_contains"]("10.0.0.0/8", _IP()), "true"),
    "ovl": (lambda: f["inet_overlap"](_IP(), "10.0.2.0/25"), "n_regionkey = 2"),
    "add": (lambda: f["inet_add"](f["host"](_IP()), 5), "'10.0.' || n_regionkey || '.' || (n_nationkey + 5)"),
    "sub": (lambda: f["inet_subtract"](f["host"](_IP()), "10.0.0.0"), "(n_regionkey * 256 + n_nationkey)::BIGINT"),
    "and": (lambda: f["inet_and"](f["host"](_IP()), "0.0.0.255"), "'0.0.0.' || n_nationkey"),
    "or": (lambda: f["inet_or"]("10.0.0.0", "0.0.0.7"), "'10.0.0.7'"),
    "not": (lambda: f["inet_not"](f["inet_not"](f["host"](_IP()))), "'10.0.' || n_regionkey || '.' || n_nationkey"),
    "mac": (lambda: f["macaddr8_set7bit"](f["macaddr"]("08002b010203")), "'0a:00:2b:ff:fe:01:02:03'"),
})
_P = lambda: f["point"](c("n_nationkey"), c("n_regionkey"))
_BX = lambda: f["box"](_P(), f["point"](0, 0))
_SG = lambda: f["lseg"](f["point"](0, 0), _P())
_PG = lambda: f["polygon"](F.array(f["point"](0, 0), f["point"](c("n_nationkey"), 0), _P()))
family("geometry_more", "nation", ["n_nationkey"], {
    "wid": (lambda: f["width"](_BX()), "n_nationkey::DOUBLE"),
    "hei": (lambda: f["height"](_BX()), "n_regionkey::DOUBLE"),
    "cen": (lambda: f["center"](_BX())["x"], "n_nationkey / 2"),
    "dia": (lambda: F.round(f["diagonal"](_BX())["a"]["x"] - f["diagonal"](_BX())["b"]["x"], 6), "n_nationkey::DOUBLE"),
    "bnd": (lambda: f["width"](f["bound_box"](_BX(), f["box"](f["point"](30, 30), f["point"](29, 29)))), "30::DOUBLE"),
    "par": (lambda: f["isparallel"](_SG(), f["lseg"](f["point"](1, 1), f["point"](c("n_nationkey") + 1, c("n_regionkey") + 1))), "true"),
    "prp": (lambda: f["isperp"](_SG(), f["lseg"](f["point"](0, 0), f["point"](-c("n_regionkey"), c("n_nationkey")))), "true"),
    "ver": (lambda: f["isvertical"](_SG()), "n_nationkey = 0"),
    "slo": (lambda: F.round(f["slope"](f["point"](0, 0), f["point"](c("n_nationkey") + 1, c("n_regionkey"))), 9), "round(n_regionkey / (n_nationkey + 1), 9)"),
    "are": (lambda: F.round(f["area"](_PG(), "polygon"), 6), "n_nationkey * n_regionkey / 2"),
    "npt": (lambda: f["npoints"](_PG()), "3"),
    "rad": (lambda: f["radius"](f["circle"](_P(), 3)) + f["diameter"](f["circle"](_P(), 3)), "9::DOUBLE"),
    "cls": (lambda: f["isclosed"](f["pclose"](f["path"](_PG(), False))) & f["isopen"](f["popen"](f["path"](_PG()))), "true"),
    "lin": (lambda: F.round(f["line"](f["point"](0, 1), f["point"](1, c("n_regionkey") + 1))["a"], 6), "n_regionkey::DOUBLE"),
})
family("xml_more", "nation", ["n_nationkey"], {
    "com": (lambda: f["xmlcomment"](c("n_name")), "'<!--' || n_name || '-->'"),
    "cat": (lambda: f["xmlconcat"](lit("<a/>"), lit("<b/>")), "'<a/><b/>'"),
    "ca2": (lambda: f["xmlconcat2"](lit("<a/>"), lit("<b/>")), "'<a/><b/>'"),
    "xml": (lambda: f["xml"](c("n_name")), "n_name"),
    "prs": (lambda: f["__xmlparse"](f["xmlelement"]("n", c("n_name"))), "'<n>' || n_name || '</n>'"),
    "exi": (lambda: f["xmlexists"]("/n", f["xmlelement"]("n", c("n_name"))), "true"),
    "xex": (lambda: f["xpath_exists"]("/m", f["xmlelement"]("n", c("n_name"))), "false"),
    "wf": (lambda: f["xml_is_well_formed"](lit("a<b/>")) & f["xml_is_well_formed_content"](lit("a<b/>")), "true"),
    "wfd": (lambda: f["xml_is_well_formed_document"](lit("a<b/>")), "false"),
})
family("casts_more", "customer", ["c_custkey"], {
    **{n: (lambda n=n: f[n](c("c_acctbal") / 100), "round_even(c_acctbal / 100, 0)::BIGINT") for n in ("int", "int2", "int8", "integer", "bigint", "smallint")},
    **{n: (lambda n=n: f[n](c("c_nationkey")), "c_nationkey::DOUBLE") for n in ("real", "float", "float4", "float8")},
    "num": (lambda: f["numeric"](c("c_acctbal"), 12, 1).cast("double"), "round(c_acctbal::DECIMAL(20,2), 1)::DOUBLE"),
    "dec": (lambda: f["decimal"](c("c_nationkey"), 12, 0).cast("long"), "c_nationkey::BIGINT"),
    "boo": (lambda: f["boolean"](c("c_nationkey")), "c_nationkey <> 0"),
    "bpc": (lambda: f["bpchar"]("ab", 4), "'ab  '"),
    "nam": (lambda: f["name"](F.repeat(lit("x"), 80)), "repeat('x', 63)"),
    "byt": (lambda: F.decode(f["bytea"](c("c_name")), "UTF-8"), "c_name"),
    "bit": (lambda: f["bit"](lit("B'101'")), "'101'"),
    "vbt": (lambda: f["varbit"](lit("0110")), "'0110'"),
    "mon": (lambda: f["money"](lit("$1,234.50")).cast("double"), "1234.5::DOUBLE"),
    "tim": (lambda: f["time"](lit("01:00:00")), "3600000000::BIGINT"),
    "tmz": (lambda: f["timetz"](lit("01:00:00+02"))["offset"], "7200"),
    "tsn": (lambda: f["timestamp"](lit("2024-01-02 03:04:05")), "TIMESTAMP '2024-01-02 03:04:05'"),
    "tsz": (lambda: f["timestamptz"](lit("2024-01-02 03:04:05")).cast("timestamp_ntz"), "TIMESTAMP '2024-01-02 03:04:05'"),
    "ine": (lambda: F.concat(f["inet"](lit("1.2.3.4")), f["cidr"](lit("/24"))), "'1.2.3.4/24'"),
    "mac": (lambda: f["macaddr8"](lit("08002b0102030405")), "'08:00:2b:01:02:03:04:05'"),
    "hst": (lambda: f["hstore"](F.concat(lit("k=>"), c("c_nationkey").cast("string")))["k"], "c_nationkey::VARCHAR"),
    "oid": (lambda: f["oid"](c("c_nationkey")) + f["xid"](c("c_nationkey")) + f["xid8"](c("c_nationkey")).cast("long"), "(3 * c_nationkey)::BIGINT"),
    "lsn": (lambda: f["pg_lsn"](lit("1/0")).cast("long"), "4294967296::BIGINT"),
    "enf": (lambda: F.concat(f["enum_first"](["a", "b"]), f["enum_last"](["a", "b"])), "'ab'"),
    "enr": (lambda: text(f["enum_range"](["a", "b", "c"], "b")), "'b|c'"),
    "enb": (lambda: text(f["enum_range_between"](["a", "b", "c"], "a", "b")), "'a|b'"),
})
family("session_and_sizes", "nation", ["n_nationkey"], {
    "psp": (lambda: f["pg_size_pretty"]((c("n_nationkey") + 20).cast("long") * 1024), "(n_nationkey + 20) || ' kB'"),
    "pbp": (lambda: f["pg_bytes_pretty"](c("n_nationkey")), "n_nationkey || ' bytes'"),
    "psb": (lambda: f["pg_size_bytes"](F.concat(c("n_nationkey").cast("string"), lit(" MB"))), "n_nationkey::BIGINT * 1048576"),
    "pcs": (lambda: f["pg_column_size"](c("n_name")), "(strlen(n_name) + 1)::INT"),
    "tz": (lambda: f["current_setting"]("spark.sql.session.timeZone"), "'UTC'"),
    "col": (lambda: f["collation"](c("n_name")) == f["pg_collation_for"](c("n_name")), "true"),
    "cst": (lambda: F.concat(f["charset"](c("n_name")), f["coercibility"](c("n_name")).cast("string")), "'utf8mb44'"),
    "who": (lambda: (f["current_user"]() == f["user"]()) & (f["session_user"]() == f["system_user"]()) & (f["current_role"]() == f["current_user"]()), "true"),
    "db": (lambda: (f["current_database"]() == f["database"]()) & (f["schema"]() == f["current_schema"]()) & F.array_contains(f["current_schemas"](), f["current_schema"]()) & f["current_catalog"]().isNotNull() & f["version"]().isNotNull() & f["connection_id"]().isNotNull(), "true"),
    "seq": (lambda: (lambda s: f["nextval"](s) + f["nextval"](s) + f["currval"](s) + f["lastval"]() + f["last_insert_id"]())(Sequence()), "9"),
    "sev": (lambda: f["setval"](Sequence(), 42), "42"),
    "tsm": (lambda: f["__tsm_fract"](100.0), "true"),
})

QUERIES = {k: v for k, v in _queries.items() if k not in _before}
ORACLE_SQL = {k: v for k, v in _sql.items() if k not in _before}
for _k in QUERIES:
    _queries.pop(_k)
    _sql.pop(_k, None)
