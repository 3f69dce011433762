"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share 150 % of all words by weight; a target stops at
twice its source, and what is over goes to the others by weight.  That is the
water level L with sum(min(cap, L * weight)) = total, found from one sorted
pass over the sources.

Draw: a source first runs through its whole epochs, floor(target / size).
What is left of the target is filled by documents in the order of exponential
keys, ``-ln(u) / w`` with u a hash of the document's key and w its quality
weight, while their running sum of words is nearest to it.

Only DataFrame expressions.  The running sum is split: every source is cut
into ranges of the key, ranges are summed, the sums are summed in order, and
rows are summed within their range, so a source with a third of all rows is
never ordered in one task.  Ranges are even for the least weight; of rows of
any weight, the fullest holds at most 1 / LEAST_WEIGHT times its even share.
Whole rows, texts included, move once, to meet what was drawn.

Defined results: null texts have size 0; the null source is the last one; a
null key hashes as the text ``null``; of repeated rows at the border any may be
drawn, they are alike, and ``mix`` gives their copies from one of them (that
with the smallest hash of all columns); documents without words are never
drawn; sources without words have target 0; an empty table gives no rows; columns other than doc_id, text and source are carried along by
``mix`` and ignored by ``allocate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, md5_unit52, table, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
LEAST_WEIGHT = 0.1
RANGE_ROWS = 250
MAX_RANGES = 4096
#: Up to this many sources the table of targets is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Signs of markup, tables and shouting, for the quality weight.
NOISE = "#*$%&|<>{}[]!?=~^0123456789"


def quality_weight(c: str = "text") -> Column:
    """From 0.1 to 1: falls with the share of noise characters; 0.1 for an empty text."""
    n = F.length(text_or_empty(c))
    noise = (n - F.length(F.translate(text_or_empty(c), NOISE, ""))) / n
    return F.when(n == 0, F.lit(LEAST_WEIGHT)).otherwise(F.greatest(F.lit(LEAST_WEIGHT), 1.0 - 4.0 * noise))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with sid (rank by code point, null last), target and epochs."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    by_level = Window.orderBy("level", "sid")
    everything = Window.partitionBy()
    level = (
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    )
    return (
        ranked.withColumn("water", level)
        .withColumn("water", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "sid", "water"))).over(everything)["water"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce("water", F.lit(0.0)) * F.col("weight")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .select("source", "source_size", "sid", "target", "epochs")
    )


def _draw(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sized (doc_id, source, size, w, ...) with source_size, target and copies, the times the row is taken."""
    n = sized.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    t = targets.withColumnRenamed("source", "_source")
    u = (md5_unit52(F.col("doc_id")).cast("double") + 0.5) / F.lit(float(2**52))
    keyed = (
        sized.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("key", -F.log(u) / F.col("w"))
        .withColumn("range", F.least(F.lit(ranges - 1), F.floor((1.0 - F.exp(F.col("key") * -LEAST_WEIGHT)) * ranges)).cast("int"))
    )
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("sid", "range")
        .agg(F.sum("size").alias("in_range"))
        .select("sid", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start") + F.col("ahead")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        keyed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, ["sid", "range"])
        .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.when(ahead + F.col("size") * 0.5 <= left, 1).otherwise(0)).otherwise(0))
        .drop("sid", "range", "key", "start", "ahead", "epochs")
    )


def allocate(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = materialise(docs.select("doc_id", "source", word_count().alias("size"), quality_weight().alias("w")), "sizes")
    return _draw(sized, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents, a row for each time one is taken, with the columns of docs."""
    key = [F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("_mark")]
    sized = materialise(docs.select(*key, word_count().alias("size"), quality_weight().alias("w")), "sizes")
    drawn = _draw(sized, **options).filter("copies > 0").groupBy("doc_id", "source", "_mark").agg(F.sum("copies").cast("int").alias("copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(*key, row).groupBy("doc_id", "source", "_mark").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("doc_id", "source", "_mark")]
    return rows.join(drawn.alias("d"), same).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return allocate(table(spark, sf_dir, "documents"))


_U = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
_BODY = "coalesce(text, '')"
SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all({_BODY}, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length({_BODY}) = 0 THEN 0.1::DOUBLE
              ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * ((length({_BODY}) - length(translate({_BODY}, '{NOISE}', '')))::DOUBLE / length({_BODY})::DOUBLE)) END AS w,
         {_U} AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid
  FROM d GROUP BY source),
c AS (
  SELECT *, ([5.0, 2.0, 1.0])[(sid % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS level,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
  FROM c),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT x.water FROM l x WHERE x.water <= x.level ORDER BY x.level, x.sid LIMIT 1), 0.0::DOUBLE) * weight) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN ahead + size * 0.5::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
