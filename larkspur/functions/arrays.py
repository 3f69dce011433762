"""Array functions: positions from 1, nulls equal to each other where the reference says so."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import col, cols


def array_positions(a, x):
    return F.filter(F.transform(col(a), lambda v, i: F.when(v.eqNullSafe(col(x)), i + 1)), lambda v: v.isNotNull())


def array_length(a, dimension: int = 1):
    a = col(a) if dimension == 1 else F.get(col(a), F.lit(0))
    return F.nullif(F.size(a), F.lit(0))


def array_fill(value, sizes: list[int]):
    out = col(value)
    for n in reversed(sizes):
        out = F.array_repeat(out, n)
    return out


def array_to_string(a, separator: str, null: str | None = None):
    a = F.transform(col(a), lambda v: v.cast("string"))
    return F.array_join(a, separator, null) if null is not None else F.array_join(a, separator)


def array_dims(a):
    n = F.size(col(a))
    return F.when(n > 0, F.format_string("[1:%d]", n))


def assign(a, place, value):
    """The array with element `place` set; grows with nulls up to it."""
    a, place = col(a), col(place).cast("int")
    grown = F.concat(a, F.array_repeat(F.get(a, F.lit(-1)), F.greatest(place - F.size(a), F.lit(0))))
    return F.transform(grown, lambda v, i: F.when(i + 1 == place, col(value)).otherwise(v))


def assign_slice(a, low, high, values):
    a = col(a)
    return F.concat(F.slice(a, 1, col(low) - 1), col(values), F.slice(a, col(high) + 1, F.greatest(F.size(a) - col(high), F.lit(0))))


def contains(a, b):
    """a @> b: nulls match nothing."""
    return F.forall(col(b), lambda x: F.coalesce(F.array_contains(col(a), x), F.lit(False)))


def any_of(x, op, a):
    """x op ANY (a), by three-valued logic."""
    tests = F.transform(col(a), lambda v: op(col(x), v))
    return F.when(F.exists(tests, lambda t: F.coalesce(t, F.lit(False))), True).when(F.exists(tests, lambda t: t.isNull()), F.lit(None).cast("boolean")).otherwise(False)


def all_of(x, op, a):
    """x op ALL (a), by three-valued logic."""
    tests = F.transform(col(a), lambda v: op(col(x), v))
    return F.when(F.exists(tests, lambda t: F.coalesce(~t, F.lit(False))), False).when(F.exists(tests, lambda t: t.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def slice_(a, low, high):
    """a[low:high], both ends included; empty outside."""
    begin = F.greatest(col(low), F.lit(1))
    return F.slice(col(a), begin, F.greatest(F.least(col(high), F.size(col(a))) - begin + 1, F.lit(0)))


def ndims(a):
    """Number of dimensions, from the type; null for an empty array."""
    nested = F.regexp_extract(F.typeof(col(a)), "^((?:array<)+)", 1)
    return F.when(F.size(col(a)) > 0, (F.length(nested) / 6).cast("int"))


FUNCTIONS = {
    "array_append": cols(F.array_append),
    "array_prepend": lambda x, a: F.array_prepend(col(a), col(x)),
    "array_cat": cols(F.concat),
    "array_length": array_length,
    "array_upper": array_length,
    "array_lower": lambda a, dimension=1: F.when(array_length(a, dimension).isNotNull(), F.lit(1)),
    "array_ndims": ndims,
    "array_dims": array_dims,
    "cardinality": cols(F.cardinality),
    "array_position": lambda a, x: F.nullif(F.array_position(col(a), col(x)), F.lit(0)),
    "array_positions": array_positions,
    "array_remove": lambda a, x: F.filter(col(a), lambda v: ~v.eqNullSafe(col(x))),
    "array_replace": lambda a, x, y: F.transform(col(a), lambda v: F.when(v.eqNullSafe(col(x)), col(y)).otherwise(v)),
    "array_reverse": cols(F.reverse),
    "array_sort": lambda a, descending=False, nulls_first=None: _sorted(a, descending, descending if nulls_first is None else nulls_first),
    "array_sample": lambda a, n, seed=None: F.slice(F.shuffle(col(a), seed), 1, n),
    "array_shuffle": lambda a, seed=None: F.shuffle(col(a), seed),
    "array_fill": array_fill,
    "array_to_string": array_to_string,
    "trim_array": lambda a, n: F.slice(col(a), F.lit(1), F.size(col(a)) - col(n)),
    "generate_subscripts": lambda a, dimension=1: F.explode(F.sequence(F.lit(1), F.size(col(a)))),
    "__array_assign": assign,
    "__array_assign_slice": assign_slice,
}


def _sorted(a, descending, nulls_first):
    values = F.sort_array(F.filter(col(a), lambda v: v.isNotNull()), not descending)
    nulls = F.filter(col(a), lambda v: v.isNull())
    return F.concat(nulls, values) if nulls_first else F.concat(values, nulls)
