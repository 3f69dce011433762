"""Changes to tables as functions from rows to rows: each gives the table as it is afterwards, and, where asked, the rows affected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.select(*target.columns))


def delete(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    return target.join(source, on, "left_anti")


def update(target: DataFrame, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    test = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
    return target.select(*[(F.when(test, changes[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in target.columns])


def _first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the least row of each as struct _row, and how many rows _n it has; keys with a null are left out."""
    some = rows.dropna(subset=keys)
    return some.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_row"), F.count("*").alias("_n"))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """Rows of target with a match in source take the changes, which may name both sides by t. and s.; of several matches the least row counts."""
    one = _first_of_each(source, keys).select("_row.*").withColumn("_hit", F.lit(True))
    joined = target.alias("t").join(one.alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left")
    return joined.select(*[(F.when(F.col("s._hit"), changes[c]).otherwise(F.col(f"t.{c}")) if c in changes else F.col(f"t.{c}")).alias(c) for c in target.columns])


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], changes: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE: changes may name t. (the row there) and s. (the row proposed); None: DO NOTHING.

    A key proposed twice is an error with DO UPDATE, and added once with DO NOTHING; null keys never conflict.
    """
    rows = rows.select(*target.columns)
    one = _first_of_each(rows, keys)
    if changes is not None:
        twice = F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time"))
        one = one.filter(F.when(F.col("_n") > 1, twice.cast("boolean")).otherwise(True))
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), one.select("_row.*").withColumn("_s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full")
    changes = changes or {}

    def value(c):
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        kept = F.when(F.col("s._s"), changes[c]).otherwise(old) if c in changes else old
        return F.when(F.col("t._t"), kept).otherwise(new).alias(c)

    return both.select(*map(value, target.columns)).unionByName(_with_null_key(rows, keys))


def _with_null_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return rows.filter(null)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT IGNORE: of the proposed rows with a key, one is added if the key is not there; null keys never conflict."""
    rows = rows.select(*target.columns)
    first = _first_of_each(rows, keys).select("_row.*").join(target.select(*keys), keys, "left_anti")
    return target.unionByName(first.select(*target.columns)).unionByName(_with_null_key(rows, keys))


@dataclass
class When:
    """A clause of MERGE: for "matched", "not matched" or "not matched by source" rows that meet the condition, "update", "delete", "insert" or "nothing"."""

    rows: str
    action: str
    values: dict[str, Column] | None = None
    condition: Column | None = None


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    matched_update: dict[str, Column] | None = None,
    matched_delete: Column | None = None,
    not_matched_insert: dict[str, Column] | None = None,
    not_matched_by_source_delete: Column | None = None,
    with_action: bool = False,
    clauses: list[When] | None = None,
) -> DataFrame:
    """MERGE INTO target USING source ON keys; expressions name t. and s.

    The first clause that fits a row acts; clauses come in any number, or one of a kind by the arguments
    before.  A target row on which two source rows act is an error.  With with_action, a column merge_action
    says what became of each row: UPDATE, DELETE, INSERT or null, and deleted rows are kept for a RETURNING
    clause to show.
    """
    if clauses is None:
        clauses = [When("matched", "delete", None, matched_delete)] if matched_delete is not None else []
        clauses += [When("matched", "update", matched_update)] if matched_update is not None else []
        clauses += [When("not matched", "insert", not_matched_insert)] if not_matched_insert is not None else []
        clauses += [When("not matched by source", "delete", None, not_matched_by_source_delete)] if not_matched_by_source_delete is not None else []
    kinds = {f.name: f.dataType for f in target.schema}
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    t = target.withColumn("_id", F.monotonically_increasing_id()).alias("t")
    s = source.withColumn("_hit", F.lit(True)).alias("s")

    def chosen(rows: str) -> Column:
        """The number of the clause that acts."""
        out = F.lit(None).cast("int")
        for n, c in reversed(list(enumerate(clauses))):
            if c.rows == rows:
                out = F.when(F.coalesce(c.condition, F.lit(False)) if c.condition is not None else F.lit(True), n).otherwise(out)
        return out

    def applied(old, new: bool) -> list[Column]:
        def value(c):
            out = old(c)
            for n, w in enumerate(clauses):
                if w.values and c in w.values and (w.rows == "not matched") == new:
                    out = F.when(F.col("_clause") == n, w.values[c].cast(kinds[c])).otherwise(out)
            return out.alias(c)

        return [value(c) for c in target.columns]

    def action() -> Column:
        out = F.lit(None).cast("string")
        for n, w in enumerate(clauses):
            if w.action != "nothing":
                out = F.when(F.col("_clause") == n, w.action.upper()).otherwise(out)
        return out

    here = t.join(s, on, "left").withColumn("_clause", F.when(F.col("s._hit"), chosen("matched")).otherwise(chosen("not matched by source"))).withColumn("merge_action", action())
    # the matches of a target row lie together already: the join deals by the keys
    one = Window.partitionBy(*[F.col(f"t.{k}") for k in keys], F.col("t._id"))
    twice = F.raise_error(F.lit("MERGE command cannot affect row a second time")).cast("boolean")
    here = here.withColumns({"_acts": F.count("merge_action").over(one), "_nth": F.row_number().over(one.orderBy(F.col("merge_action").asc_nulls_last()))})
    here = here.filter(F.when(F.col("_acts") > 1, twice).otherwise(F.col("_nth") == 1)).select(*applied(lambda c: F.col(f"t.{c}"), False), "merge_action")
    new = s.join(t, on, "left_anti").withColumn("_clause", chosen("not matched")).withColumn("merge_action", action()).filter(F.col("merge_action") == "INSERT")
    out = here.unionByName(new.select(*applied(lambda c: F.lit(None).cast(kinds[c]), True), "merge_action"))
    return out if with_action else out.filter(~F.col("merge_action").eqNullSafe("DELETE")).drop("merge_action")


def returning(merged: DataFrame) -> DataFrame:
    """The rows that a merge with with_action touched."""
    return merged.filter(F.col("merge_action").isNotNull())
