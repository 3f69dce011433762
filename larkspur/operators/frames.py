"""Window frames that Spark has no syntax for, GROUPS and EXCLUDE, and ranks of few, large partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import shared_root


#: Peer groups that one task may number and that may be broadcast.
FEW = 100_000


def _peers(df: DataFrame, partition: list[str], order: list[tuple[Column, bool]], partials: dict[str, Column]) -> tuple[DataFrame, DataFrame, bool]:
    """df with the values of its order as _o0, _o1...; a row for each peer group, with _n rows, _before it and _total of its
    partition, its _number and the partials; whether these are few.

    Rows are counted by group before anything is sorted, so a task holds groups and not rows.  More groups than
    FEW are written by ranges of their order; within a range they are numbered, and the ranges' sums are put before.
    """
    keyed = df.withColumns({f"_o{i}": e for i, (e, _) in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    by = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, (_, down) in zip(names, order, strict=True)]
    peers = keyed.groupBy(*partition, *names).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in partials.items()])
    few = peers.limit(FEW + 1).count() <= FEW
    spark, first = df.sparkSession, Window.unboundedPreceding
    if few:
        w = Window.partitionBy(*partition).orderBy(*by)
        sums = {"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(first, -1)), F.lit(0)), "_number": F.row_number().over(w).cast("long"), "_total": F.sum("_n").over(Window.partitionBy(*partition))}
        return keyed, peers.withColumns(sums), few
    path = f"{shared_root(spark).rstrip('/')}/peers-{uuid.uuid4().hex}"
    peers.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *map(F.col, partition), *by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    over = Window.partitionBy(*partition).orderBy("_range").rowsBetween(first, -1)
    sums = ranged.groupBy(*partition, "_range").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    sums = sums.withColumns({"_rows_before": F.coalesce(F.sum("_rows").over(over), F.lit(0)), "_groups_before": F.coalesce(F.sum("_groups").over(over), F.lit(0)), "_total": F.sum("_rows").over(Window.partitionBy(*partition))})
    w = Window.partitionBy(*partition, "_range").orderBy(*by)
    inside = ranged.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(first, -1)), F.lit(0)), "_number": F.row_number().over(w).cast("long")})
    both = _looked_up(inside, sums, [*partition, "_range"], ["_rows_before", "_groups_before", "_total"])
    return keyed, both.withColumns({"_before": F.col("_before") + F.col("_rows_before"), "_number": F.col("_number") + F.col("_groups_before")}).drop("_range", "_rows_before", "_groups_before"), few


def _looked_up(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str], broadcast: bool = False) -> DataFrame:
    """df with columns of other's row of the same keys, nulls being equal."""
    o = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(F.broadcast(o) if broadcast else o, same).select(*df.columns, *columns)


_RANKS = {
    "rank": lambda before, n, number, total: before + 1,
    "dense_rank": lambda before, n, number, total: number,
    "percent_rank": lambda before, n, number, total: F.when(total > 1, before / (total - 1)).otherwise(0.0),
    "cume_dist": lambda before, n, number, total: (before + n) / total,
    "rows_to": lambda before, n, number, total: before + n,
    "rows_after": lambda before, n, number, total: total - before - n,
}


def ranks(df: DataFrame, partition: list[str], order: list[tuple[Column, bool]], names: dict[str, str]) -> DataFrame:
    """df and by name rank, dense_rank, percent_rank, cume_dist, rows_to (count(*) over the default frame) or rows_after it.

    order: values, and whether they go down; nulls are last.  All of these are the same for peers, so they are
    reckoned by peer group and looked up by the rows, which are not sorted.
    """
    keyed, peers, few = _peers(df, partition, order, {})
    found = peers.withColumns({name: _RANKS[kind](F.col("_before"), F.col("_n"), F.col("_number"), F.col("_total")) for name, kind in names.items()})
    own = [f"_o{i}" for i in range(len(order))]
    return _looked_up(keyed, found, [*partition, *own], list(names), few).drop(*own)


def groups(df: DataFrame, partition: list[str], order: list[tuple[Column, bool]], start: int, end: int, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND end (offsets of peer groups; Window.unbounded... for none).

    order as in ranks; aggregates: name -> (sum, count, min or max, value).  Each peer group is aggregated once,
    a RANGE frame over the groups' numbers puts groups together, and rows look their group's result up.  Of more
    groups than FEW, each goes to the frames it is in; a frame without bounds has them sorted by one task a partition.
    """
    make = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    keyed, peers, few = _peers(df, partition, order, {f"_p_{name}": make[kind](value) for name, (kind, value) in aggregates.items()})
    types = {name: peers.schema[f"_p_{name}"].dataType for name in aggregates}

    def together(name: str, over=None) -> Column:
        kind = aggregates[name][0]
        found = make["sum" if kind == "count" else kind](f"_p_{name}")
        found = (found if over is None else found.over(over)).cast(types[name])
        return F.coalesce(found, F.lit(0)).alias(name) if kind == "count" else found.alias(name)

    own = [f"_o{i}" for i in range(len(order))]
    if few or start == Window.unboundedPreceding or end == Window.unboundedFollowing:
        w = Window.partitionBy(*partition).orderBy("_number").rangeBetween(start, end)
        found = peers.select(*partition, *own, *[together(name, w) for name in aggregates])
    else:
        sent = peers.withColumn("_number", F.explode(F.sequence(F.col("_number") - end, F.col("_number") - start)))
        none = peers.select(*partition, "_number", *[F.lit(None).cast(types[name]).alias(f"_p_{name}") for name in aggregates])
        frames = sent.select(none.columns).unionByName(none).groupBy(*partition, "_number").agg(*[together(name) for name in aggregates])
        found = _looked_up(peers, frames, [*partition, "_number"], list(aggregates))
    return _looked_up(keyed, found, [*partition, *own], list(aggregates), few).drop(*own)


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _partials(kind) -> dict:
    """By aggregate: over a window, of an array of structs v, and of two results; a missing piece gives null or an empty list."""
    total = kind.simpleString()

    def array_sum(x):
        return F.aggregate(x, F.lit(None).cast(total), lambda acc, y: F.coalesce((acc + y["v"].cast(total)).cast(total), acc, y["v"].cast(total)))

    return {
        "sum": (lambda v: F.sum("_v"), array_sum, lambda a, b: _add(a, b).cast(total)),
        "count": (lambda v: F.count("_v"), lambda x: F.size(F.filter(x, lambda y: y["v"].isNotNull())).cast("long"), lambda a, b: a + b),
        "min": (lambda v: F.min("_v"), lambda x: F.array_min(F.transform(x, lambda y: y["v"])), F.least),
        "max": (lambda v: F.max("_v"), lambda x: F.array_max(F.transform(x, lambda y: y["v"])), F.greatest),
        "array_agg": (lambda v: F.collect_list(F.struct(F.col("_v").alias("v"))), lambda x: x, F.concat),
    }


def excluding(
    df: DataFrame, partition: list[str], order: list[Column], value: Column, exclude: str, aggregates: dict[str, str], start: int = Window.unboundedPreceding, end: int = Window.currentRow, unit: str = "rows"
) -> DataFrame:
    """Aggregates of value over a frame less what EXCLUDE takes out: "current row", "group", "ties" or "no others".

    aggregates: column -> sum, count, min, max, avg or array_agg.  What is left of a frame lies in pieces
    before and after what is excluded; each piece is a frame of its own, and their results are put together,
    so types stay and nothing is taken off again.  Of a frame of rows, the piece on a bounded side is found
    among that many rows at most.
    """
    peers = Window.partitionBy(*partition).orderBy(*order)
    by = df.withColumns({"_v": value, "_nth": F.row_number().over(peers), "_group": F.dense_rank().over(peers)})
    kind = by.select(F.sum("_v") if "sum" in aggregates.values() or "avg" in aggregates.values() else F.max("_v")).schema[0].dataType
    inside = start <= 0 <= end  # whether the current row, and with groups its peers, are in the frame
    rows, groups_ = Window.partitionBy(*partition).orderBy("_nth"), Window.partitionBy(*partition).orderBy("_group")
    own = Window.partitionBy(*partition, "_group").orderBy("_nth")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    by = by.withColumns({"_before": F.row_number().over(own) - 1, "_after": F.count("*").over(own.rowsBetween(1, last))})

    def beside(over, array):
        """The pieces of a frame of rows on both sides of the peers."""
        if start < 0:
            if start == first:
                whole = over(groups_.rangeBetween(first, -1))
                yield whole if end >= -1 else F.when(F.col("_before") >= -end, whole).otherwise(over(rows.rowsBetween(first, end)))
            else:
                near = F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_group").alias("g"))).over(rows.rowsBetween(start, min(end, -1)))
                yield array(F.transform(F.filter(near, lambda x: x["g"] < F.col("_group")), lambda x: F.struct(x["v"].alias("v"))))
        yield None  # what is left of the peers stands here
        if end > 0:
            if end == last:
                whole = over(groups_.rangeBetween(1, last))
                yield whole if start <= 1 else F.when(F.col("_after") >= start, whole).otherwise(over(rows.rowsBetween(start, last)))
            else:
                near = F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_group").alias("g"))).over(rows.rowsBetween(max(start, 1), end))
                yield array(F.transform(F.filter(near, lambda x: x["g"] > F.col("_group")), lambda x: F.struct(x["v"].alias("v"))))

    def whole_sides(over, window, between):
        """The pieces of a frame of rows, or of groups, before and after the current one."""
        if start < 0:
            yield over(between(window, start, min(end, -1)))
        yield None
        if end > 0:
            yield over(between(window, max(start, 1), end))

    def pieces(name):
        make, array, _ = partials[name]
        over = lambda w: make(None).over(w)
        this = array(F.array(F.struct(F.col("_v").alias("v"))))
        range_, rows_ = (lambda w, a, b: w.rangeBetween(a, b)), (lambda w, a, b: w.rowsBetween(a, b))
        if exclude == "no others":
            return [over(rows_(rows, start, end) if unit == "rows" else range_(groups_, start, end))]
        if unit == "rows" and exclude in ("group", "ties"):
            sides = list(beside(over, array))
        elif unit == "rows":
            sides = list(whole_sides(over, rows, rows_))
        else:
            sides = list(whole_sides(over, groups_, range_))
        middle = []
        if inside and exclude == "ties":
            middle = [this]
        elif inside and exclude == "current row" and unit != "rows":
            middle = [over(rows_(own, first, -1)), over(rows_(own, 1, last))]
        at = next(i for i, x in enumerate(sides) if x is None)
        return [x for x in [*sides[:at], *middle, *sides[at:]] if x is not None]

    partials = _partials(kind)

    def result(name):
        if name == "avg":
            n = result("count")
            return F.when(n > 0, result("sum").cast("double" if not kind.simpleString().startswith("decimal") else kind.simpleString()) / n)
        found = pieces(name)
        if not found:
            return F.lit(0).cast("long") if name == "count" else F.lit(None)
        out = found[0]
        for x in found[1:]:
            out = partials[name][2](out, x)
        return F.transform(out, lambda x: x["v"]) if name == "array_agg" else out

    columns = {column: result(name) for column, name in aggregates.items()}
    return by.withColumns(columns).drop("_v", "_nth", "_group", "_before", "_after")
