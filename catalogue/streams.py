"""Streaming bars and snapshots, run to the end of the available input."""

from pyspark.sql import functions as F

from catalogue.common import EVENT_DAYS, INTRADAY, emit, portable, query
from catalogue.intraday import CONTEXT, FEATURE_SPEC, RUNNING, SNAPS
from quaymark import schemas
from quaymark.session import work_path
from quaymark.sources import derived
from quaymark.streaming import bars as stream_bars_job
from quaymark.streaming import snapshots as stream_snapshots_job


def stream_bars(spark, folder):
    stream = stream_bars_job.bars(stream_bars_job.tick_stream(spark, folder))
    return portable(stream_bars_job.write_available(stream, spark, "bars").drop("ts_end"))


def stream_bars_hourly(spark, folder):
    stream = stream_bars_job.bars(stream_bars_job.tick_stream(spark, folder), "60 minutes")
    return portable(stream_bars_job.write_available(stream, spark, "bars").drop("ts_end"))


def _bar_stream(spark, folder):
    """The session bars of the ticks as a file stream."""
    path = work_path(spark, "session-bars")
    bars = derived.intraday_bars(spark, folder)
    bars.write.parquet(path)
    return spark.readStream.schema(bars.schema).parquet(path).withWatermark("ts", "1 hour")


def stream_snapshot(spark, folder):
    stream = stream_snapshots_job.snapshot_stream(_bar_stream(spark, folder), derived.event_days(spark, folder))
    return portable(stream_bars_job.write_available(stream, spark, "snapshots"))


def stream_scored(spark, folder):
    """Scored with fixed coefficients."""
    tickers = derived.event_days(spark, folder).select("ticker").distinct()
    weights = [0.1 if c == "ret_last_bar" else 0.0 for c in schemas.SNAPSHOT_FEATURES]
    fixed = tickers.select("ticker", F.lit(0.01).alias("intercept"), F.array(*[F.lit(w) for w in weights]).alias("coefficients"))
    stream = stream_snapshots_job.scored_stream(_bar_stream(spark, folder), derived.event_days(spark, folder), fixed)
    done = stream_bars_job.write_available(stream, spark, "scored")
    return portable(done.select("ticker", "date", "ts", "price_now", "prediction", "predicted_close"))


def _closed(minutes: int) -> str:
    return (
        "w AS (SELECT *, event_type AS ticker, time_bucket(INTERVAL {0} MINUTE, ts, TIMESTAMP '2024-01-01') AS w0 FROM events), "
        "b AS (SELECT ticker, w0 AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, "
        "CAST(count(*) AS DOUBLE) AS volume FROM w WHERE w0 + INTERVAL {0} MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ticker, w0)"
    ).format(minutes)


BAR_SPEC = "ticker ts:t open:f high:f low:f close:f volume:f"
QUERIES = {
    "stream_bars": stream_bars,
    "stream_bars_hourly": stream_bars_hourly,
    "stream_snapshot": stream_snapshot,
    "stream_scored": stream_scored,
}
ORACLES = {
    "stream_bars": query(_closed(5), emit("b", BAR_SPEC)),
    "stream_bars_hourly": query(_closed(60), emit("b", BAR_SPEC)),
    "stream_snapshot": query(
        EVENT_DAYS,
        INTRADAY,
        CONTEXT,
        RUNNING,
        SNAPS,
        emit("snapall", f"ticker date:d ts:t {FEATURE_SPEC} price_now:f") + " WHERE bar_no >= 2",
    ),
    "stream_scored": query(
        EVENT_DAYS,
        INTRADAY,
        CONTEXT,
        RUNNING,
        SNAPS,
        "s AS (SELECT ticker, date, ts, price_now, bar_no, CASE WHEN vol_ratio_vs_typical IS NOT NULL AND range_so_far_pct IS NOT NULL AND prev_day_return IS NOT NULL THEN 0.01::DOUBLE + 0.1::DOUBLE * ret_last_bar END AS prediction FROM snapall)",
        "p AS (SELECT *, price_now * (1 + prediction) AS predicted_close FROM s WHERE bar_no >= 2)",
        emit("p", "ticker date:d ts:t price_now:f prediction:f predicted_close:f"),
    ),
}
