"""Recursive queries: UNION with removal of repetitions, SEARCH and CYCLE."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import shared_root

#: Rounds whose rows stay apart.
COMPACT = 10


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int | None = None) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows that are new feed the next round until there are none, or for most_rounds.

    Each round's rows are checkpointed once; what is known is the union of the rounds, put together anew
    whenever there are COMPACT parts, so the plan does not grow with the rounds.
    """
    _needs_checkpoints(seed)
    known = [seed.distinct().checkpoint()]
    frontier = known[0]
    for n in count():
        if most_rounds is not None and n == most_rounds:
            raise RuntimeError(f"the recursion did not end in {most_rounds} rounds")
        so_far = _union(known)
        frontier = step(frontier).subtract(so_far).checkpoint()  # nulls count as equal
        if frontier.isEmpty():
            return so_far
        known.append(frontier)
        if len(known) == COMPACT:
            known = [_union(known).checkpoint()]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _needs_checkpoints(df: DataFrame) -> None:
    """The shared folder named in spark.checkpoint.dir; a temporary one where that is unset and there is one machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))


def walk(seed: DataFrame, edges: DataFrame, node: str, source: str, target: str, most_depth: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Paths from seed along edges, without going round in circles.

    Adds depth, path (the nodes so far) and is_cycle (the last node stood in the path before; such a path ends),
    which is what CYCLE ... SET and SEARCH need: order by path for DEPTH FIRST, by depth and path for BREADTH FIRST.
    """
    _needs_checkpoints(seed)
    carry = carry or []
    now = seed.select(node, *carry, F.lit(0).alias("depth"), F.array(node).alias("path"), F.lit(False).alias("is_cycle"))
    out = now
    for n in count():
        if most_depth is not None and n == most_depth:
            raise RuntimeError(f"paths are longer than {most_depth}")
        nxt = now.filter(~F.col("is_cycle")).join(edges.select(F.col(source).alias(node), F.col(target).alias("_next")), node)
        now = nxt.select(
            F.col("_next").alias(node),
            *carry,
            (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("_next")).alias("path"),
            F.array_contains("path", F.col("_next")).alias("is_cycle"),
        ).checkpoint()
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def search_order(how: str) -> list[Column]:
    """What to order the rows of walk by."""
    return [F.col("path")] if how == "depth first" else [F.col("depth"), F.col("path")]
