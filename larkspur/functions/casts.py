"""Casts and type constructors: PostgreSQL names of types, with its rounding where Spark truncates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import col, cols, python


def whole(kind: str):
    """Doubles round half to even, decimals half away from zero, before the cast."""

    @cols
    def cast(x):
        t = F.typeof(x)
        as_double = F.rint(x.cast("double")).cast(kind)
        return F.when(t.isin("double", "float"), as_double).when(t.startswith("decimal"), F.round(x.cast("decimal(38,10)"), 0).cast(kind)).otherwise(x.try_cast(kind))

    return cast


def to(kind: str):
    return cols(lambda x: x.cast(kind))


def numeric(x, precision: int = 38, scale: int = 10):
    return F.round(col(x).cast("decimal(38,18)"), scale).cast(f"decimal({precision},{scale})")


def character(x, n: int = 1):
    """Blank-padded to n."""
    return F.rpad(F.substring(col(x).cast("string"), 1, n), n, " ")


def varchar(x, n: int | None = None):
    return col(x).cast("string") if n is None else F.substring(col(x).cast("string"), 1, n)


@cols
def bit(x):
    """A string of 0 and 1."""
    return F.regexp_replace(x.cast("string"), "[^01]", "")


def time_micros(x):
    """Time of day in microseconds since midnight, from text or timestamp."""
    t = F.concat(F.lit("1970-01-01 "), col(x).cast("string"))
    return F.unix_micros(F.coalesce(col(x).try_cast("timestamp"), t.try_cast("timestamp"))) % F.lit(86_400_000_000)


@python("struct<time:bigint,offset:int>")
def timetz(text):
    """Microseconds since midnight and seconds east of UTC."""
    import re

    m = re.fullmatch(r"\s*(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?\s*(?:([+-])(\d+)(?::?(\d\d))?|Z)?\s*", text)
    if not m:
        raise ValueError(f"invalid time: {text}")
    h, mi, s, frac, sign, oh, om = m.groups()
    micros = ((int(h) * 60 + int(mi)) * 60 + int(s or 0)) * 1_000_000 + int((frac or "0").ljust(6, "0")[:6])
    return {"time": micros, "offset": (int(oh or 0) * 3600 + int(om or 0) * 60) * (-1 if sign == "-" else 1)}


@python("decimal(20,0)")
def pg_lsn(text):
    import decimal

    high, low = text.split("/")
    return decimal.Decimal((int(high, 16) << 32) | int(low, 16))


@python("map<string,string>")
def hstore(text):
    import re

    out, part = {}, r'(?:"((?:[^"\\]|\\.)*)"|([^\s=>,"]+))'
    for m in re.finditer(part + r"\s*=>\s*" + part, text):
        key = re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]
        out[key] = re.sub(r"\\(.)", r"\1", m[3]) if m[3] is not None else None if m[4].upper() == "NULL" else m[4]
    return out


def enum_functions(labels: list[str]) -> dict:
    """enum_first, enum_last, enum_range, and the ordinal that an enum sorts by."""
    array = F.array(*[F.lit(x) for x in labels])
    at = lambda x, default: F.lit(default) if x is None else F.nullif(F.array_position(array, col(x)), F.lit(0)).cast("int")
    between = lambda low=None, high=None: F.slice(array, at(low, 1), at(high, len(labels)) - at(low, 1) + 1)
    return {"enum_first": F.lit(labels[0]), "enum_last": F.lit(labels[-1]), "enum_range": between, "enum_range_between": between, "ordinal": lambda x: at(x, 0)}


FUNCTIONS = {
    "int": whole("int"),
    "int2": whole("smallint"),
    "int4": whole("int"),
    "int8": whole("bigint"),
    "integer": whole("int"),
    "smallint": whole("smallint"),
    "bigint": whole("bigint"),
    "numeric": numeric,
    "decimal": numeric,
    "real": to("float"),
    "float": to("double"),
    "float4": to("float"),
    "float8": to("double"),
    "bool": to("boolean"),
    "boolean": to("boolean"),
    "text": to("string"),
    "varchar": varchar,
    "bpchar": character,
    "character": character,
    "name": cols(lambda x: F.substring(x.cast("string"), 1, 63)),
    "bytea": to("binary"),
    "date": to("date"),
    "time": time_micros,
    "timetz": timetz,
    "timestamp": to("timestamp_ntz"),
    "timestamptz": to("timestamp"),
    "interval": lambda text: F.expr(f"INTERVAL '{text}'"),
    "bit": bit,
    "varbit": bit,
    "__bit_literal": bit,
    "money": cols(lambda x: F.round(F.regexp_replace(x.cast("string"), "[$,]", "").cast("decimal(30,6)"), 2).cast("decimal(19,2)")),
    "inet": to("string"),
    "cidr": to("string"),
    "macaddr": cols(lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "[^0-9A-Fa-f]", ""), "(..)(?!$)", "$1:"))),
    "macaddr8": cols(lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, "[^0-9A-Fa-f]", ""), "(..)(?!$)", "$1:"))),
    "hstore": hstore,
    "oid": to("bigint"),
    "pg_lsn": pg_lsn,
    "xid": to("bigint"),
    "xid8": to("decimal(20,0)"),
    "enum_first": lambda labels: enum_functions(labels)["enum_first"],
    "enum_last": lambda labels: enum_functions(labels)["enum_last"],
    "enum_range": lambda labels, low=None, high=None: enum_functions(labels)["enum_range"](low, high),
    "enum_range_between": lambda labels, low=None, high=None: enum_functions(labels)["enum_range"](low, high),
}
