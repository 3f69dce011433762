"""Sessions and tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: What the engine's results rest on; everything else is left to the cluster.
CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "larkspur", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()


_own_dirs: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as a URI: spark.checkpoint.dir; a temporary one where that is unset and all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="larkspur-")
            sc.setCheckpointDir(_own_dirs[sc.applicationId])
        root = _own_dirs[sc.applicationId]
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows or 4 MB, where the caller left Spark's defaults: texts may be long, and Python holds a batch many times over."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", str(4 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """text over the tables of sf_dir that it names; :name parameters from args."""
    lower = text.lower()
    for name in TABLES:
        if name in lower:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)
