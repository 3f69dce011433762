"""Event-time aggregation, sessions, deduplication, joins and upkeep of views as streams.

Each builder takes a streaming (or batch) DataFrame with a column ts; `run` drives one to the end of its input.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.session import shared_root

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, name: str = "events", schema: str = EVENTS, files_per_batch: int = 8) -> DataFrame:
    """The files of a table as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """Count and sum by event type and window."""
    return df.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sliding(df: DataFrame, width: str, slide: str, late: str = "0 seconds") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_of_each(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(df: DataFrame) -> DataFrame:
    """Per user: events so far and the largest value, by state of our own; a row each time a user's state changes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for batch in batches:
            n += len(batch)
            top = max(top, float(batch["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    return df.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)


def run(df: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drive a streaming query to the end of its input; its rows as a batch DataFrame.

    Executors write each batch to the shared folder, so no rows pass through the driver; "complete" gives
    the last batch, "update" and "append" give all.  State is held in RocksDB, which spills to disk, and not
    in the heap of the executors.
    """
    spark = df.sparkSession
    root = f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        last[0] = max(last[0], number)

    with _state_on_disk(spark):
        query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if last[0] < 0:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{root}/rows/batch={last[0]}" if mode == "complete" else f"{root}/rows/batch=*")


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """While a stream starts and runs, RocksDB holds its state, unless the session names a store of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key)
    if own.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, own.replace("HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def maintain(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """foreachBatch until the input ends: upkeep of a stored view from the rows that came (triggers, incremental views)."""
    query = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
