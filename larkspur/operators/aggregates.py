"""Aggregates that Spark lacks or spells otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hypothetical_rank(value: Column, arg) -> Column:
    """rank(arg) WITHIN GROUP (ORDER BY value)."""
    return F.count_if(value < F.lit(arg)) + 1


def hypothetical_dense_rank(value: Column, arg) -> Column:
    return F.count_distinct(F.when(value < F.lit(arg), value)) + 1


def hypothetical_percent_rank(value: Column, arg) -> Column:
    return F.count_if(value < F.lit(arg)) / F.greatest(F.count("*"), F.lit(1))


def hypothetical_cume_dist(value: Column, arg) -> Column:
    return (F.count_if(value <= F.lit(arg)) + 1) / (F.count("*") + 1)


def array_agg(value: Column, *order: Column) -> Column:
    """All values, nulls too, in order."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, value.alias("v")))), lambda r: r["v"])


def string_agg(value: Column, separator: str, *order: Column) -> Column:
    return F.array_join(array_agg(value, *order), separator)


def json_agg(value: Column, *order: Column) -> Column:
    """A JSON array; null values are null elements."""
    return F.to_json(array_agg(value, *order), {"ignoreNullFields": "false"})


def json_agg_strict(value: Column, *order: Column) -> Column:
    return F.to_json(F.filter(array_agg(value, *order), lambda v: v.isNotNull()))


def _member(pair: Column) -> Column:
    """"key":value as JSON."""
    value = F.to_json(F.array(pair["value"]), {"ignoreNullFields": "false"})
    name = F.to_json(F.array(pair["key"].cast("string")))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)  # noqa: E731  without the brackets
    return F.concat(F.when(pair["key"].isNull(), F.raise_error(F.lit("field name must not be null")).cast("string")).otherwise(inner(name)), F.lit(":"), inner(value))


def _pairs(key: Column, value: Column, *order: Column) -> Column:
    """Sorted by key and then by order."""
    return F.sort_array(F.collect_list(F.struct(key.alias("key"), *[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("value"))))


def _object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, _member), ","), F.lit("}"))


def json_object_agg(key: Column, value: Column, *order: Column) -> Column:
    """A JSON object in the order of keys; repeated keys are all kept, as the json type does."""
    return _object(_pairs(key, value, *order))


def jsonb_object_agg(key: Column, value: Column, *order: Column) -> Column:
    """A JSON object in the order of keys; of repeated keys the last by order is kept, as the jsonb type does."""
    pairs = _pairs(key, value, *order)
    return _object(F.filter(pairs, lambda x, i: ~F.get(pairs, i + 1)["key"].eqNullSafe(x["key"]) | x["key"].isNull()))


def json_object_agg_strict(key: Column, value: Column) -> Column:
    return _object(F.filter(_pairs(key, value), lambda x: x["value"].isNotNull()))


def range_parts(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and, a row for each, the ranges of the multirange that the ranges of each group cover; _part is their order.

    Ranges hold their lower bounds and not their upper (see functions.ranges.discrete).  Equal ranges of a
    group are one before they are sorted; a range that begins beyond all upper bounds before it begins a new part.
    """
    r = F.col(value)
    spans = df.filter(r.isNotNull() & ~r["empty"]).select(*keys, r["lower"].alias("_low"), r["upper"].alias("_high")).distinct()
    by = Window.partitionBy(*keys).orderBy(F.col("_low").asc_nulls_first(), F.col("_high").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.row_number().over(by).eqNullSafe(1) | (F.coalesce(F.col("_low") > F.max("_high").over(before), F.lit(False)) & ~F.bool_or(F.col("_high").isNull()).over(before))
    parts = spans.withColumn("_new", apart.cast("int")).withColumn("_part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.when(F.bool_or(F.col("_low").isNull()), None).otherwise(F.min("_low")), F.when(F.bool_or(F.col("_high").isNull()), None).otherwise(F.max("_high"))
    whole = parts.groupBy(*keys, "_part").agg(low.alias("_low"), high.alias("_high"))
    one = F.struct(F.col("_low").alias("lower"), F.col("_high").alias("upper"), F.col("_low").isNotNull().alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(False).alias("empty"))
    return whole.select(*keys, "_part", one.alias(name))


def range_agg(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the multirange that the ranges of each group cover, as one value (see range_parts)."""
    sets = range_parts(df, keys, value, "_r").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_part", F.col("_r").alias("r")))), lambda x: x["r"]).alias(name))
    return df.select(*keys).distinct().join(sets, keys, "left")


def range_intersect_agg(value: Column) -> Column:
    """The range common to all; ranges hold their lower bounds and not their upper (see functions.ranges.discrete)."""
    low, high = F.max(value["lower"]), F.min(value["upper"])
    empty = F.bool_or(value["empty"]) | F.coalesce(low >= high, F.lit(False))
    return F.struct(F.when(~empty, low).alias("lower"), F.when(~empty, high).alias("upper"), (low.isNotNull() & ~empty).alias("lower_inc"), F.lit(False).alias("upper_inc"), empty.alias("empty"))


def xmlagg(value: Column, *order: Column) -> Column:
    return string_agg(value, "", *order)


def count_distinct_salted(df, keys: list[str], value: str, salts: int = 32):
    """Distinct counts of few, very large groups: distinct values per hashed part first, then the sum of their counts."""
    parts = df.select(*keys, value).groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(salts)).alias("_salt")).agg(F.count_distinct(value).alias("_n"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("n"))
