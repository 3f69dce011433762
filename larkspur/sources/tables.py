"""Row sources without files: literal rows and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """start to stop, both included, without building an array."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def series_of(low: Column, high: Column, step: Column) -> Column:
    """A series within a row, one row for each value; for times, step is an interval."""
    return F.explode(F.sequence(low, high, step))


def with_ordinality(df: DataFrame, array: str, value: str, ordinality: str = "ordinality") -> DataFrame:
    """unnest(array) WITH ORDINALITY beside the other columns."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias("_p", value)).withColumn(ordinality, (F.col("_p") + 1).cast("long")).drop("_p")


def rows_from(df: DataFrame, **arrays: Column) -> DataFrame:
    """ROWS FROM (f, g): arrays side by side, the shorter ones padded with nulls."""
    names = list(arrays)
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    return df.select("*", F.explode(zipped).alias("_z")).select(*df.columns, *[F.col("_z").getField(str(i) if n not in names else n).alias(n) for i, n in enumerate(names)])
