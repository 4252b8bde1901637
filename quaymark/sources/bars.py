"""Bar tables: readers, ticks to bars, the unsettled-bar filter and the outage guard."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.functions import dates


def read_bars(spark: SparkSession, path: str, schema=schemas.DAILY_BARS, fmt: str | None = None) -> DataFrame:
    """Bars from CSV (header row) or Parquet with a declared schema, unsettled rows removed."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read.schema(schema)
    frame = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return settled(frame)


def settled(bars: DataFrame) -> DataFrame:
    """Drop bars without a close: the provider has not settled them yet. NaN counts as missing."""
    return bars.withColumn("close", F.nanvl("close", F.lit(None).cast("double"))).where(F.col("close").isNotNull())


def collect_series(frames: dict[str, DataFrame], name_column: str = "ticker") -> DataFrame:
    """One long table out of per-instrument tables, named by ``name_column``."""
    named = [frame.withColumn(name_column, F.lit(name)) for name, frame in frames.items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), named)


def rename_symbols(bars: DataFrame, names: dict[str, str], column: str = "ticker") -> DataFrame:
    """Provider symbols to instrument names; symbols without a name are dropped."""
    lookup = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return bars.where(F.col(column).isin(list(names))).withColumn(column, lookup[F.col(column)])


def latest_per_day(bars: DataFrame, tie: Column, *keys: str) -> DataFrame:
    """Keep the last row of each (instrument, day); ``tie`` orders the rows of a day."""
    others = [F.col(name) for name in bars.columns if name not in keys]
    last = F.max_by(F.struct(*others), tie).alias("_last")
    return bars.groupBy(*keys).agg(last).select(*keys, "_last.*")


def bars_from_ticks(ticks: DataFrame, price: str, order: Column, *keys: str) -> DataFrame:
    """Open/high/low/close/volume per group of ``keys``.

    Every aggregate combines before the shuffle, so a hot instrument costs one row per task and day.
    """
    value = F.col(price)
    return ticks.groupBy(*keys).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def session_bars(ticks: DataFrame, price: str, tick_id: str, minutes: int = 60) -> DataFrame:
    """Bars of ``minutes`` inside 09:30-16:00, aligned to 09:30. Needs ``ticker`` and local ``ts``."""
    minute_of_day = F.hour("ts") * 60 + F.minute("ts")
    start = F.window("ts", f"{minutes} minutes", startTime=f"{30 % minutes} minutes")["start"]
    inside = ticks.where((minute_of_day >= 570) & (minute_of_day < config.SESSION_CLOSE_MINUTE))
    return bars_from_ticks(
        inside.withColumn("_start", start), price, dates.event_order(F.col("ts"), F.col(tick_id)), "ticker", "_start"
    ).withColumnRenamed("_start", "ts")


def guard_outage(current: DataFrame, incoming: DataFrame, key: str = "ticker") -> DataFrame:
    """Per instrument take ``incoming`` unless it shrank below half of a cached table of > 20 rows.

    Instruments that arrive for the first time are taken; instruments that did not arrive are kept.
    Rows are counted before any exchange, so a large instrument costs one row per task; the verdicts, a row
    per instrument, meet the bars in a join that can split large instruments.
    """
    tagged = current.withColumn("_fresh", F.lit(False)).unionByName(incoming.withColumn("_fresh", F.lit(True)))
    sizes = tagged.groupBy(key).agg(
        F.count_if("_fresh").alias("_fresh_n"), F.count_if(~F.col("_fresh")).alias("_cached_n")
    )
    shrank = (F.col("_cached_n") > config.GUARD_MIN_ROWS) & (
        F.col("_fresh_n") < F.col("_cached_n") * config.GUARD_RATIO
    )
    keep_cached = (F.col("_fresh_n") == 0) | shrank
    verdicts = sizes.select(key, keep_cached.alias("_keep_cached"))
    return tagged.join(verdicts, key).where(F.col("_fresh") != F.col("_keep_cached")).drop("_fresh", "_keep_cached")


def unrefused(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The instruments of ``incoming`` that did not shrink below half of a cached table of > 20 rows."""
    sizes = current.groupBy("ticker").agg(F.count(F.lit(1)).alias("_cached_n"))
    fresh = incoming.groupBy("ticker").agg(F.count(F.lit(1)).alias("_fresh_n"))
    refused = sizes.join(fresh, "ticker").where(
        (F.col("_cached_n") > config.GUARD_MIN_ROWS)
        & (F.col("_fresh_n") < F.col("_cached_n") * config.GUARD_RATIO)
    )
    return incoming.join(refused, "ticker", "left_anti")


def upsert_bars(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Write ``incoming`` over the store at ``path``, partitioned by ticker, behind the outage guard."""
    try:
        current = spark.read.parquet(path).select(*incoming.columns)
    except Exception as error:  # no store yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        accepted = incoming
    else:
        accepted = unrefused(current, incoming)
    (
        accepted.hint("rebalance", "ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .parquet(path)
    )
