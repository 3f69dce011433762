"""Declared partitioning: routing of rows by range, list or hash, reading of single files, views and upkeep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_range(value: Column, bounds: dict[str, tuple]) -> Column:
    """The partition whose half-open range holds the value; None as a bound is no limit; DEFAULT without one."""
    out = F.when(F.lit(False), F.lit(""))
    for name, (low, high) in bounds.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= F.lit(low))
        if high is not None:
            inside = inside & (value < F.lit(high))
        out = out.when(inside & value.isNotNull(), F.lit(name))
    return out.otherwise(F.lit("DEFAULT"))


def by_list(value: Column, lists: dict[str, list]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, values in lists.items():
        test = value.isin([v for v in values if v is not None])
        out = out.when(test | value.isNull() if None in values else test, F.lit(name))
    return out.otherwise(F.lit("DEFAULT"))


def by_hash(value: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(modulus)).cast("int")


def write_partitioned(df: DataFrame, partition: Column, path: str, name: str = "part") -> None:
    """A folder for each partition; readers prune by the column `name`."""
    df.withColumn(name, partition).repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)


def as_of_segment(spark: SparkSession, path: str, segment: str) -> DataFrame:
    """Rows of one file of a table."""
    return spark.read.parquet(path).filter(F.col("_metadata.file_name") == segment)


def inherit(*tables: DataFrame) -> DataFrame:
    """A parent with its children: columns by name, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


@dataclass
class MaterializedView:
    """A query's stored rows, computed anew when its sources changed since the last refresh."""

    spark: SparkSession
    path: str
    query: Callable[[], DataFrame]
    version: Callable[[], object]
    _seen: object = field(default=None)

    def refresh(self) -> bool:
        """Whether anything was done."""
        now = self.version()
        if self._seen is not None and self._seen == now:
            return False
        self.query().write.mode("overwrite").parquet(self.path)
        self._seen = now
        return True

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


class Cursor:
    """A scrollable position over an ordered result; rows come a page at a time."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self._df, self._order, self._at = df, order, 0

    def fetch(self, n: int = 1) -> list:
        """The next n rows, or the n before if negative."""
        if n < 0:
            end = max(0, self._at - 1)
            begin = max(0, end + n)
            rows = self._page(begin, end - begin)[::-1]
            self._at = begin + (1 if rows else 0)
            return rows
        rows = self._page(self._at, n)
        self._at += len(rows)
        return rows

    def move(self, n: int) -> None:
        self._at = max(0, self._at + n)

    def absolute(self, n: int) -> list:
        self._at = max(0, n - 1)
        return self.fetch(1)

    def _page(self, offset: int, limit: int) -> list:
        return self._df.orderBy(*self._order).offset(offset).limit(limit).collect() if limit > 0 else []


@dataclass
class Constraints:
    """Checks to hold rows against: not null, unique, check, foreign key; each gives the rows that break it."""

    df: DataFrame

    def not_null(self, column: str) -> DataFrame:
        return self.df.filter(F.col(column).isNull())

    def unique(self, *columns: str) -> DataFrame:
        some = F.lit(True)
        for c in columns:
            some = some & F.col(c).isNotNull()
        return self.df.filter(some).groupBy(*columns).count().filter("count > 1").drop("count")

    def check(self, condition: Column) -> DataFrame:
        return self.df.filter(~F.coalesce(condition, F.lit(True)))

    def foreign_key(self, column: str, other: DataFrame, key: str) -> DataFrame:
        return self.df.filter(F.col(column).isNotNull()).join(other.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")

    def exclude_overlaps(self, by: str, low: str, high: str) -> DataFrame:
        """Rows whose span overlaps the one before it in their group (EXCLUDE USING &&)."""
        from pyspark.sql import Window

        before = F.max(high).over(Window.partitionBy(by).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))
        return self.df.withColumn("_before", before).filter(F.col(low) < F.col("_before")).drop("_before")


def row_security(df: DataFrame, policies: list[Column]) -> DataFrame:
    """Rows that some policy lets through."""
    allowed = F.lit(False)
    for p in policies:
        allowed = allowed | F.coalesce(p, F.lit(False))
    return df.filter(allowed)
