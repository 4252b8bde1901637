"""Ticks to bars with event time and watermarks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaymark import schemas
from quaymark.functions import dates
from quaymark.session import work_path

LATENESS = "10 minutes"


def tick_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Ticks arriving as Parquet files: (ticker, ts, event_id, value)."""
    reader = spark.readStream.schema(schemas.TICKS).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )


def bars(ticks: DataFrame, width: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """Bars per instrument and window. State is one row per open window; later ticks are dropped.

    The same function works on a static table, where the watermark has no effect.
    """
    order = dates.event_order(F.col("ts"), F.col("event_id"))
    grouped = ticks.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "ticker")
    return grouped.agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ).select("ticker", F.col("w.start").alias("ts"), F.col("w.end").alias("ts_end"), "open", "high", "low", "close", "volume")


def write_available(frame: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over everything available into files below the shared folder and read them."""
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    query: StreamingQuery = (
        frame.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)
