"""Choosing rows: distinct on, limits with ties, top k per group, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def distinct_on_values(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """distinct_on by a partial aggregation instead of a sort of each group: nothing but the best row so far leaves a task.

    order must be of an orderable type; the smallest wins.  For keys with very many rows.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def with_ties(df: DataFrame, n: int, order: list[tuple[Column, bool]]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES, by (expression, descending) pairs.

    The peers of the n-th row are found by its values, so no task ranks all rows.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({name: e for name, (e, _) in zip(names, order, strict=True)})
    by = [F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_last() for name, (_, down) in zip(names, order, strict=True)]
    first = keyed.select(*names).orderBy(*by).limit(n).distinct()  # at most n rows
    same = [F.col(f"k.{name}").eqNullSafe(F.col(f"f.{name}")) for name in names]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return keyed.alias("k").join(F.broadcast(first).alias("f"), condition, "left_semi").drop(*names)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each key, or all whose rank is within k; Spark prunes each task to k before the shuffle."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", rank).filter(F.col("_nth") <= k).drop("_nth")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE BERNOULLI: exact at 0 and 100."""
    if percent <= 0:
        return df.limit(0)
    return df if percent >= 100 else df.sample(percent / 100.0, seed)


def sample_by_key(df: DataFrame, key: str, percent: float) -> DataFrame:
    """A sample that stays the same from run to run and follows the key, not the layout."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(percent * 100))
