"""Joins beyond the kinds Spark spells: as-of, range, skewed, merged USING, null-aware anti."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import ranges


def using(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: one column for each key, from the side that has it."""
    return left.join(right, keys, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL JOIN: USING all common columns; a cross join without any."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """NOT EXISTS: rows with null keys stay."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """key NOT IN (other): nothing if other holds a null; rows with a null key only if the right side is empty."""
    facts = right.agg(F.count("*").alias("_n"), F.count(other).alias("_known"))  # one row
    keys = right.select(F.col(other).alias("_k")).distinct()
    kept = left.join(keys, F.col(key) == F.col("_k"), "left_anti").crossJoin(F.broadcast(facts))
    return kept.filter((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(key).isNotNull())).drop("_n", "_known")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (before, if strict).

    Both sides are laid in one stream per key and time, and the last right row is carried forward:
    one shuffle by key, no pairs.  Right columns are null where there is none.
    """
    values = [c for c in right.columns if c not in by]
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[c for c in left.columns if c not in by]).alias("_l"), F.lit(None).alias("_r"))
    marks = right.select(*by, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).alias("_l"), F.struct(*values).alias("_r"))
    both = rows.unionByName(marks)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull()).select(*by, "_l.*", "_r.*")


def in_range(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """points join spans on low <= point < high, by buckets of a width: an equi-join in place of all pairs.

    A span is repeated for each bucket it touches, so choose the width near the usual length of spans.
    """
    by = by or []
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, [*by, "_b"]).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def in_parts(points: DataFrame, parts: DataFrame, keys: list[str], point: str, part: str, cuts: int = 64) -> DataFrame:
    """points whose value lies in a range of their keys; parts hold ranges apart from each other, a row for each (see aggregates.range_parts).

    Only the last range that begins at or before a point can hold it.  Both sides are cut at `cuts` quantiles of
    the points, ranges that reach over a cut stand on both sides, and within keys and cuts one sorted pass finds
    that range: no pairs, and the rows are the points, the ranges and at most `cuts` more for each key.
    Equal points are one until they are decided.
    """
    r, x = F.col(part), F.col(point)
    known = points.filter(x.isNotNull())
    distinct = known.select(*keys, x.alias("_x")).distinct()
    edges = F.broadcast(distinct.agg(F.array_distinct(F.approx_percentile("_x", [i / cuts for i in range(1, cuts)])).alias("_cuts")))  # one row
    place = lambda v: F.size(F.filter("_cuts", lambda c: c <= v))
    p = distinct.crossJoin(edges).select(*keys, place(F.col("_x")).alias("_cut"), F.col("_x").alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_r"))
    reach = F.sequence(F.when(r["lower"].isNull(), 0).otherwise(place(r["lower"])), F.when(r["upper"].isNull(), F.size("_cuts")).otherwise(place(r["upper"])))
    s = parts.filter(~r["empty"]).crossJoin(edges).select(*keys, F.explode(reach).alias("_cut"), r["lower"].alias("_t"), F.lit(0).alias("_side"), r.alias("_r"))
    w = Window.partitionBy(*keys, "_cut").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = p.unionByName(s).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    held = found.filter(F.col("_r").isNotNull() & ranges.has(F.col("_r"), F.col("_t"))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_t").alias("_x"))
    same = x == F.col("_x")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return known.join(held, same, "left_semi")


def salted(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over `salts` partitions.

    hot: the keys that hold so many rows of big that one task should not take them; it must be small
    enough to broadcast (see heavy_keys).  Rows of small with those keys are repeated for each salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep big's rows can be salted")
    marked = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    b = big.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    s = small.join(marked, keys, "left").withColumn("_salt", every).drop("_hot")
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys with at least a share of all rows: at most 1 / share of them, so they can be broadcast."""
    n = df.count()
    return df.groupBy(*keys).count().filter(F.col("count") >= max(2, math.ceil(n * share))).select(*keys)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def any_of(left: DataFrame, value: Column, right: DataFrame, other: str, op: str) -> DataFrame:
    """value op ANY (other): for order comparisons, one comparison with the least or greatest; = is a semi join."""
    if op == "=":
        return left.join(right.select(F.col(other).alias("_k")), value == F.col("_k"), "left_semi")
    pick = F.min if op in (">", ">=") else F.max
    edge = right.agg(pick(other).alias("_edge"))
    return left.crossJoin(F.broadcast(edge)).filter(_compare(value, op)).drop("_edge")


def all_of(left: DataFrame, value: Column, right: DataFrame, other: str, op: str) -> DataFrame:
    """value op ALL (other): true of an empty right side, unknown with nulls in it."""
    pick = F.max if op in (">", ">=") else F.min
    edge = right.agg(pick(other).alias("_edge"), F.count("*").alias("_n"), F.count(other).alias("_known"))
    test = (F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & _compare(value, op))
    return left.crossJoin(F.broadcast(edge)).filter(test).drop("_edge", "_n", "_known")


def _compare(value: Column, op: str) -> Column:
    edge = F.col("_edge")
    return {">": value > edge, ">=": value >= edge, "<": value < edge, "<=": value <= edge}[op]
