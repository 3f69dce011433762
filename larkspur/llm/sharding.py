"""Rendezvous hashing of stable record keys over weighted shards.

Every record scores each shard with a hash of (key, shard); the best score
wins.  Adding a shard adds one score and leaves the others as they are, so a
record moves only if the new shard wins it.  With weights, the score is
``ln(u) / weight``, which gives each shard its share; with equal weights that
orders as the hash itself, which is then compared directly.

Only DataFrame expressions: hashing is per row, and the gapless slots come
from counts per (shard, bucket), a prefix sum over at most 65,536 such counts,
and a row number within each bucket, so no shard is ever ordered in one task.

Defined results: a null key is the text ``null`` (all such records share a
shard); a null text has size 1 and the checksum of the empty text; repeated
rows get the same shard and neighbouring slots; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, md5_unit52, table, text_or_empty

BUCKET_ROWS = 500
MAX_BUCKETS = 65_536


def shard_scores(key: Column, weights: list[float]) -> Column:
    """Array of (score, -shard), so that the largest is the winner and ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    even = min(weights) == max(weights)

    def score(s: int) -> Column:
        h = md5_unit52(key, F.lit(s)).cast("double")
        return h if even else F.log((h + 0.5) / F.lit(float(2**52))) / F.lit(float(weights[s]))

    return F.array(*[F.struct(score(s).alias("score"), F.lit(-s).alias("neg")) for s in range(len(weights))])


def assign(df: DataFrame, key: str, weights: list[float], shard_col: str = "shard") -> DataFrame:
    """df with the shard of each row."""
    return df.withColumn(shard_col, -F.array_max(shard_scores(F.col(key), weights))["neg"])


def shard_documents(docs: DataFrame, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    weights = weights or [1.0] * 16
    n_shards = len(weights)
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS // n_shards, math.ceil(n / n_shards / BUCKET_ROWS)))
    scores = (
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
        )
        .withColumn("scores", shard_scores(F.col("doc_id"), [*weights, grown_weight]))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (-F.array_max(F.slice("scores", 1, n_shards))["neg"]).alias("shard"),
            (-F.array_max("scores")["neg"]).alias("grown_shard"),
            F.pmod(md5_unit52(F.col("doc_id"), F.col("text_crc32"), F.col("size")), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )
    keyed = materialise(scores, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return (
        keyed.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])  # at most MAX_BUCKETS rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op3_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _hash(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


_KEY = "coalesce(doc_id::VARCHAR, 'null')"
_ALL = ", ".join(_hash(_KEY, f"'{s}'") for s in range(17))
#: CRC-32 as a fold over the bytes of the text (reflected polynomial 0xEDB88320).
SQL = f"""
WITH tbl AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
b AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h, [{_ALL}] AS scores,
         greatest(1, least({MAX_BUCKETS // 16}, ceil(count(*) OVER () / 16.0 / {BUCKET_ROWS})))::BIGINT AS buckets
  FROM documents),
k AS (
  SELECT doc_id, size, buckets,
         xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
         (list_position(scores[1:16], list_max(scores[1:16])) - 1)::INT AS shard,
         (list_position(scores, list_max(scores)) - 1)::INT AS grown_shard
  FROM b, tbl),
p AS (
  SELECT *, {_hash(_KEY, "text_crc32", "size")} % buckets AS bucket FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM p
"""
