"""Vector distances over arrays of numbers, and exact nearest neighbours of a few query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """NaN where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1.0 - inner_product(a, b) / F.nullif(size, F.lit(0.0)))


DISTANCES = {"l2": l2_distance, "inner": negative_inner_product, "cosine": cosine_distance}


def nearest(df: DataFrame, vector: str, query: list[float], k: int, distance: str = "l2", tie: str | None = None) -> DataFrame:
    """ORDER BY vector <-> query LIMIT k: exact, one pass, k rows from each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    order = [F.col("distance")] + ([F.col(tie)] if tie else [])
    return df.withColumn("distance", DISTANCES[distance](F.col(vector), q)).orderBy(*order).limit(k)


def sq8(a: Column) -> Column:
    """A vector as bytes 0..255 between its own least and greatest component: struct<low, step, codes>."""
    low, high = F.array_min(a), F.array_max(a)
    step = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(1.0))
    return F.struct(low.cast("float").alias("low"), step.cast("float").alias("step"), F.transform(a, lambda x: F.round((x - low) / step).cast("smallint")).alias("codes"))


def from_sq8(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (q["low"] + c * q["step"]).cast("float"))
