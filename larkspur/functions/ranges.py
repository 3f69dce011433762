"""Ranges as struct<lower, upper, lower_inc, upper_inc, empty>, null bounds without limit; multiranges as arrays of them.

Whole-number and date ranges are canonical: they hold their lower bound and not their upper.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col


def _build(lower, upper, lower_inc, upper_inc) -> Column:
    nothing = (lower > upper) | ((lower == upper) & ~(lower_inc & upper_inc))
    empty = F.coalesce(nothing, F.lit(False))
    return F.struct(
        F.when(~empty, lower).alias("lower"),
        F.when(~empty, upper).alias("upper"),
        (lower.isNotNull() & lower_inc & ~empty).alias("lower_inc"),
        (upper.isNotNull() & upper_inc & ~empty).alias("upper_inc"),
        empty.alias("empty"),
    )


def continuous(kind: str):
    def make(lower, upper, bounds: str = "[)"):
        return _build(col(lower).cast(kind), col(upper).cast(kind), F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"))

    return make


def discrete(kind: str):
    def make(lower, upper, bounds: str = "[)"):
        step = (lambda x: F.date_add(x, 1)) if kind == "date" else (lambda x: (x + 1).cast(kind))
        lo, hi = col(lower).cast(kind), col(upper).cast(kind)
        given = _build(lo, hi, F.lit(bounds[0] == "["), F.lit(bounds[1] == "]"))
        return F.when(given["empty"], given).otherwise(_build(lo if bounds[0] == "[" else step(lo), step(hi) if bounds[1] == "]" else hi, F.lit(True), F.lit(False)))

    return make


def _begins_first(a, b):
    """Whether a's lower bound lies at or before b's."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _ends_last(a, b):
    return a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))


def before(a, b):
    """a << b: a ends before b begins."""
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def overlap(a, b):
    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def has(a, x):
    """a @> x, a single value."""
    low = a["lower"].isNull() | (a["lower"] < col(x)) | ((a["lower"] == col(x)) & a["lower_inc"])
    high = a["upper"].isNull() | (a["upper"] > col(x)) | ((a["upper"] == col(x)) & a["upper_inc"])
    return ~a["empty"] & low & high


def contains(a, b):
    return b["empty"] | (~a["empty"] & _begins_first(a, b) & _ends_last(a, b))


def contained(a, b):
    return contains(b, a)


def adjacent(a, b):
    meet = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meet(a, b) | meet(b, a))


def not_right(a, b):
    """a &< b: a does not reach beyond b's end."""
    return ~a["empty"] & ~b["empty"] & _ends_last(b, a)


def not_left(a, b):
    return ~a["empty"] & ~b["empty"] & _begins_first(b, a)


def _empty_like(a):
    return _build(F.when(F.lit(False), a["lower"]), F.when(F.lit(False), a["upper"]), F.lit(False), F.lit(False)).withField("empty", F.lit(True))


def intersection(a, b):
    low, high = F.when(_begins_first(a, b), b).otherwise(a), F.when(_ends_last(a, b), b).otherwise(a)
    return F.when(overlap(a, b), _build(low["lower"], high["upper"], low["lower_inc"], high["upper_inc"])).otherwise(_empty_like(a))


def merge(a, b):
    """The smallest range that holds both."""
    low, high = F.when(_begins_first(a, b), a).otherwise(b), F.when(_ends_last(a, b), a).otherwise(b)
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(_build(low["lower"], high["upper"], low["lower_inc"], high["upper_inc"]))


def union(a, b):
    """merge, where the two touch; an error otherwise."""
    ok = a["empty"] | b["empty"] | overlap(a, b) | adjacent(a, b)
    return F.when(ok, merge(a, b)).otherwise(F.raise_error(F.lit("result of range union would not be contiguous")))


def difference(a, b):
    """a without b; an error where b would cut a in two."""
    starts, ends = _begins_first(b, a), _ends_last(b, a)
    left = _build(a["lower"], b["lower"], a["lower_inc"], ~b["lower_inc"])
    right = _build(b["upper"], a["upper"], ~b["upper_inc"], a["upper_inc"])
    return F.when(~overlap(a, b), a).when(starts & ends, _empty_like(a)).when(starts, right).when(ends, left).otherwise(F.raise_error(F.lit("result of range difference would not be contiguous")))


def normalise(ranges) -> Column:
    """Sorted, without empty ranges, those that touch merged."""
    kept = F.array_sort(
        F.filter(col(ranges), lambda r: r.isNotNull() & ~r["empty"]),
        lambda x, y: F.when(_begins_first(x, y) & _begins_first(y, x), 0).when(_begins_first(x, y), -1).otherwise(1),
    )
    touch = lambda x, y: overlap(x, y) | adjacent(x, y)

    def add(out, r):
        last = F.get(out, F.size(out) - 1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merge(last, r)))
        return F.when((F.size(out) > 0) & touch(last, r), joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(kept, F.slice(kept, 1, 0), add)


def multirange(*ranges):
    return normalise(F.array(*ranges))


def multi_union(a, b):
    return normalise(F.concat(col(a), col(b)))


def multi_intersection(a, b):
    return normalise(F.flatten(F.transform(col(a), lambda x: F.transform(col(b), lambda y: intersection(x, y)))))


def multi_difference(a, b):
    """Every range of a, cut by every range of b."""

    def cut(parts, y):
        def pieces(x):
            left = _build(x["lower"], y["lower"], x["lower_inc"], ~y["lower_inc"])
            right = _build(y["upper"], x["upper"], ~y["upper_inc"], x["upper_inc"])
            inside = F.array(F.when(_begins_first(y, x), _empty_like(x)).otherwise(left), F.when(_ends_last(y, x), _empty_like(x)).otherwise(right))
            return F.when(overlap(x, y), inside).otherwise(F.array(x))

        return F.flatten(F.transform(parts, pieces))

    return normalise(F.aggregate(normalise(b), normalise(a), cut))


def multi_has(a, x):
    return F.exists(col(a), lambda r: has(r, x))


def _bounded_less(a, b):
    """Order of ranges: empty first, then by lower, then by upper bound."""
    return F.when(a["empty"] | b["empty"], a["empty"] & ~b["empty"]).otherwise(_begins_first(a, b) & (~_begins_first(b, a) | (_ends_last(b, a) & ~_ends_last(a, b))))


def show(r) -> Column:
    """The text form."""
    bound = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    text = F.concat(F.when(r["lower_inc"], "[").otherwise("("), bound(r["lower"]), F.lit(","), bound(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")"))
    return F.when(r["empty"], F.lit("empty")).otherwise(text)


def read(text, kind: str) -> Column:
    """From the text form."""
    t = F.trim(col(text))
    part = lambda i: F.nullif(F.trim(F.regexp_extract(t, r'^([\[(])\s*"?([^",]*)"?\s*,\s*"?([^"\])]*)"?\s*([\])])$', i), chars('"')), F.lit("")).cast(kind)
    whole = kind in ("int", "bigint", "date")
    step = (lambda x: F.date_add(x, 1)) if kind == "date" else (lambda x: (x + 1).cast(kind))
    lo, hi, lo_inc, hi_inc = part(2), part(3), t.startswith("["), t.endswith("]")
    if whole:
        given = _build(F.when(lo_inc, lo).otherwise(step(lo)), F.when(hi_inc, step(hi)).otherwise(hi), F.lit(True), F.lit(False))
    else:
        given = _build(lo, hi, lo_inc, hi_inc)
    return F.when(F.lower(t) == "empty", _empty_like(given)).otherwise(given)


def chars(x):
    return F.lit(x)


FUNCTIONS = {
    "int4range": discrete("int"),
    "int8range": discrete("bigint"),
    "numrange": continuous("decimal(38,10)"),
    "daterange": discrete("date"),
    "tsrange": continuous("timestamp_ntz"),
    "tstzrange": continuous("timestamp"),
    **{f"{t}multirange": multirange for t in ("int4", "int8", "num", "date", "ts", "tstz")},
    "multirange": multirange,
    "lower_inc": lambda r: r["lower_inc"],
    "upper_inc": lambda r: r["upper_inc"],
    "lower_inf": lambda r: ~r["empty"] & r["lower"].isNull(),
    "upper_inf": lambda r: ~r["empty"] & r["upper"].isNull(),
    "isempty": lambda r: r["empty"],
    "range_merge": merge,
    "range_adjacent": adjacent,
}
