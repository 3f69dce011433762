"""Helpers for writing functions of Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cols(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with every argument made a Column."""

    @wraps(f)
    def wrapped(*args):
        return f(*map(col, args))

    return wrapped


def python(returns: str, strict: bool = True, bind: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """A Python function of values as a function of Columns, in Arrow batches; strict: null for any null argument.

    bind: texts and numbers given as they are go with the function and not as columns.  What is left with
    one argument that is itself such a function runs in the same pass, row by row: its values never leave Python.
    """

    def decorate(f: Callable) -> Callable[..., Column]:
        def value(*args):
            if strict and any(a is None for a in args):
                return None
            return f(*args)

        value.__name__ = getattr(f, "__name__", "value")
        udfs: dict = {}

        @wraps(f)
        def wrapped(*args):
            fixed = tuple((i, type(a), a) for i, a in enumerate(args) if bind and isinstance(a, (str, int, float)))
            if len(fixed) == len(args):
                fixed = ()
            if fixed not in udfs:
                udfs[fixed] = F.udf(_bound(value, fixed) if fixed else value, returns, useArrow=True)
            at = {i for i, *_ in fixed}
            return udfs[fixed](*[col(a) for i, a in enumerate(args) if i not in at])

        return wrapped

    return decorate


#: Results of a costly function that a task keeps: columns repeat their values.
KNOWN = 10_000


def kept(f: Callable) -> Callable:
    """f of values that can be keys, which keeps its results; equal arguments must give equal results."""
    known: dict = {}

    @wraps(f)
    def look(*args):
        if args not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[args] = f(*args)
        return known[args]

    return look


def _bound(f: Callable, fixed: tuple) -> Callable:
    """f of the arguments that are not fixed as (place, type, value)."""

    def value(*args):
        rest = list(args)
        for i, _, a in fixed:
            rest.insert(i, a)
        return f(*rest)

    value.__name__ = f.__name__
    return value


def null_if_any(result: Column, *args: Column) -> Column:
    """result, or null where an argument is null."""
    any_null = args[0].isNull()
    for a in args[1:]:
        any_null = any_null | a.isNull()
    return F.when(any_null, F.lit(None)).otherwise(result)
