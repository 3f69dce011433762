"""Conditional and comparison helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import col, cols


def num_nulls(*args):
    return sum((col(a).isNull().cast("int") for a in args), F.lit(0))


def num_nonnulls(*args):
    return sum((col(a).isNotNull().cast("int") for a in args), F.lit(0))


@cols
def overlaps(s1, e1, s2, e2):
    """Whether two periods, given by their ends in any order, share time: half-open, an instant counts as itself."""
    a, b = F.least(s1, e1), F.greatest(s1, e1)
    c, d = F.least(s2, e2), F.greatest(s2, e2)
    return F.when(a == c, F.lit(True)).when(a < c, (c < b)).otherwise(a < d)


def error_on_null(x, message="null value not allowed"):
    return F.when(col(x).isNull(), F.raise_error(F.lit(message))).otherwise(col(x))


#: Spark's names of types and PostgreSQL's (fixed values).
PG_TYPES = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint", "string": "text", "double": "double precision", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "binary": "bytea", "void": "unknown"}


def pg_typeof(x):
    names = F.create_map(*[F.lit(v) for pair in PG_TYPES.items() for v in pair])
    t = F.typeof(col(x))
    return F.when(t.startswith("decimal"), F.lit("numeric")).when(t.startswith("array"), F.concat(F.coalesce(names[F.regexp_extract(t, "array<(.*)>", 1)], F.lit("text")), F.lit("[]"))).otherwise(F.coalesce(names[t], t))


def pg_input_is_valid(text, kind: str):
    known = {"integer": "int", "int4": "int", "int8": "bigint", "numeric": "decimal(38,10)", "float8": "double", "bool": "boolean", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "json": "variant", "jsonb": "variant"}
    to = known.get(kind, kind)
    return F.try_parse_json(col(text)).isNotNull() if to == "variant" else col(text).try_cast(to).isNotNull()


FUNCTIONS = {
    "coalesce": lambda *a: F.coalesce(*map(col, a)),
    "nullif": cols(F.nullif),
    "ifnull": cols(F.ifnull),
    "isnull": cols(F.isnull),
    "if": lambda c, a, b: F.when(col(c), col(a)).otherwise(col(b)),
    "greatest": lambda *a: F.greatest(*map(col, a)),
    "least": lambda *a: F.least(*map(col, a)),
    "num_nulls": num_nulls,
    "num_nonnulls": num_nonnulls,
    "error_on_null": error_on_null,
    "overlaps": overlaps,
    "any_value": lambda x: F.any_value(col(x), True),
    "row": lambda *a: F.struct(*[col(x).alias(f"f{i + 1}") for i, x in enumerate(a)]),
    "name_const": lambda name, value: F.lit(value).alias(name),
    "pg_typeof": pg_typeof,
    "pg_input_is_valid": pg_input_is_valid,
    "pg_is_json": lambda x: F.try_parse_json(col(x)).isNotNull(),
}
