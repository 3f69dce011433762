"""Connected components of a link table, by alternating large and small stars.

Each round is a few joins and aggregations of the links; its result is written
to the shared folder, so lineage stays short and lost executors cost one
round.  Labels end as the smallest node of a component.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """links (u, v: long) -> (u, v): each node that has a link, but for the smallest of its component, with that smallest node."""
    now = materialise(links.filter("u <> v").distinct(), "links")
    seen = _signature(now)
    for n in count():
        if seen[0] == 0:
            return now
        if n == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        now = materialise(_small_star(_large_star(now)), "stars")
        before, seen = seen, _signature(now)
        if seen == before:
            return now
