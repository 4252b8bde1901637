"""A store of bars in versions: data first, a manifest last, readers pinned to a version.

``data`` is partitioned by commit and ticker and only ever grows. A version is the manifest's list of the commit that holds
each ticker, so an upsert writes the tickers it changes and nothing else. A commit that fails leaves files that no version
names; the version before stays readable, also for readers that have opened it already. The manifest has a row per
instrument and version and is written as one file, which appears at once. One writer at a time.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.sources.bars import unrefused

_MANIFEST = "ticker string, commit string, version long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except Exception as error:  # no version yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _MANIFEST)


def latest(spark: SparkSession, path: str) -> int:
    """Number of the newest version; 0 where there is none."""
    return _manifest(spark, path).agg(F.max("version").alias("v")).first()["v"] or 0


def _data(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(f"{path}/data").schema
    # Partition values are read as text, whatever they look like.
    text = [T.StructField(f.name, T.StringType()) if f.name in ("ticker", "commit") else f for f in found]
    return spark.read.schema(T.StructType(text)).parquet(f"{path}/data")


def open_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The bars of a version, by default the newest; only partitions that it names are read."""
    wanted = latest(spark, path) if version is None else version
    named = _manifest(spark, path).where(F.col("version") == wanted).select("ticker", "commit")
    return _data(spark, path).join(named, ["ticker", "commit"], "left_semi").drop("commit")


def upsert(spark: SparkSession, path: str, incoming: DataFrame) -> int:
    """Write what the outage guard takes of ``incoming`` as the next version and return its number.

    Rows without a ticker are left out; where nothing is taken, the version stays.
    """
    incoming = incoming.where(F.col("ticker").isNotNull())
    version = latest(spark, path)
    if version:
        incoming = unrefused(open_version(spark, path, version).select(*incoming.columns), incoming)
    if incoming.isEmpty():
        return version
    commit = f"c{uuid.uuid4().hex}"
    out = incoming.withColumn("commit", F.lit(commit)).hint("rebalance", "ticker")
    out.write.mode("append").partitionBy("commit", "ticker").parquet(f"{path}/data")
    fresh = _data(spark, path).where(F.col("commit") == commit).select("ticker", "commit").distinct()
    before = _manifest(spark, path).where(F.col("version") == version).select("ticker", "commit")
    kept = before.join(fresh, "ticker", "left_anti")
    rows = kept.unionByName(fresh).withColumn("version", F.lit(version + 1).cast("long"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version + 1
