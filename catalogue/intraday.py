"""Intraday context, snapshots and time-bucket accuracy."""

from pyspark.sql import functions as F

from catalogue.common import EVENT_DAYS, INTRADAY, emit, portable, query
from quaymark import schemas
from quaymark.functions import dates
from quaymark.operators import intraday, metrics, splits
from quaymark.sources import derived


def _snapshots(spark, folder, **options):
    return intraday.snapshots(derived.intraday_bars(spark, folder), derived.event_days(spark, folder), **options)


def intraday_context(spark, folder):
    return portable(intraday.day_context(derived.event_days(spark, folder)))


def running_session(spark, folder):
    bars = intraday.with_session_day(derived.intraday_bars(spark, folder))
    return portable(intraday.running_session(bars))


def intraday_snapshots(spark, folder):
    return portable(_snapshots(spark, folder))


def intraday_snapshots_with_last_bar(spark, folder):
    return portable(_snapshots(spark, folder, include_last_bar=True))


def live_snapshots(spark, folder):
    """As of the newest bar of every session."""
    return portable(intraday.live_snapshots(derived.intraday_bars(spark, folder), derived.event_days(spark, folder)))


def local_session_day(spark, folder):
    """Ticks as instants in UTC on the exchange's wall clock."""
    ticks = derived.ticks(spark, folder).select("ticker", dates.local_time(F.col("ts")).alias("ts"))
    return portable(
        ticks.groupBy("ticker", F.to_date("ts").alias("date")).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(dates.minutes_until_close(F.col("ts"))).alias("avg_minutes_left"),
        )
    )


def _momentum(spark, folder):
    """The session goes on as it began: a deterministic stand-in for a fitted model."""
    snaps = splits.day_split(_snapshots(spark, folder), "ticker")
    return snaps.withColumn("prediction", F.col("ret_last_bar") * 0.1)


def day_split_counts(spark, folder):
    return portable(splits.split_audit(splits.day_split(_snapshots(spark, folder), "ticker"), "ticker"))


def time_bucket_accuracy(spark, folder):
    test = _momentum(spark, folder).where(F.col("split") == "test")
    return portable(intraday.accuracy_by_time(test, "ticker"))


def intraday_model_metrics(spark, folder):
    test = _momentum(spark, folder).where(F.col("split") == "test")
    return portable(metrics.regression_metrics(test, "ticker", actual="target_return_to_close"))


CONTEXT = (
    "c0 AS (SELECT ticker, date, close, volume, close / nullif(lag(close) OVER w, 0) - 1 AS r, "
    "CASE WHEN count(volume) OVER v >= 20 THEN avg(volume) OVER v END AS t FROM edays "
    "WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), "
    "ctx AS (SELECT ticker, date, lag(close) OVER w AS prev_close, lag(r) OVER w AS prev_day_return, lag(t) OVER w AS avg_volume_20d "
    "FROM c0 WINDOW w AS (PARTITION BY ticker ORDER BY date))"
)
RUNNING = (
    "run AS (SELECT ticker, CAST(ts AS DATE) AS date, ts, row_number() OVER w AS bar_no, count(*) OVER (PARTITION BY ticker, CAST(ts AS DATE)) AS n_bars, "
    "first_value(open) OVER w AS day_open, last_value(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS day_close, "
    "close AS price_now, lag(close) OVER w AS price_before, max(high) OVER s AS high_so_far, min(low) OVER s AS low_so_far, sum(volume) OVER s AS volume_so_far "
    "FROM ibars WINDOW w AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts), s AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING))"
)
SNAPS = (
    "j AS (SELECT run.*, prev_close, prev_day_return, avg_volume_20d, high_so_far - low_so_far AS rng, "
    "greatest(960 - (hour(ts) * 60 + minute(ts)), 0)::DOUBLE AS minutes_until_close, "
    "1 - greatest(960 - (hour(ts) * 60 + minute(ts)), 0)::DOUBLE / 390 AS frac_of_day_elapsed "
    "FROM run JOIN ctx ON ctx.ticker = run.ticker AND ctx.date = run.date WHERE prev_close IS NOT NULL), "
    "snapall AS (SELECT *, price_now / day_open - 1 AS ret_since_open, price_now / price_before - 1 AS ret_last_bar, "
    "CASE WHEN rng > 0 THEN (price_now - low_so_far) / rng ELSE 0.5 END AS pos_in_range, rng / nullif(price_now, 0) AS range_so_far_pct, "
    "day_open / prev_close - 1 AS gap_from_prev_close, CASE WHEN avg_volume_20d * frac_of_day_elapsed > 0 THEN volume_so_far / (avg_volume_20d * frac_of_day_elapsed) END AS vol_ratio_vs_typical, "
    "sin((isodow(ts) - 1) * (2 * pi() / 5)) AS dow_sin, cos((isodow(ts) - 1) * (2 * pi() / 5)) AS dow_cos, day_close / price_now - 1 AS target_return_to_close FROM j), "
    "snaps AS (SELECT * FROM snapall WHERE n_bars >= 3 AND bar_no >= 2 AND bar_no < n_bars AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in [*schemas.SNAPSHOT_FEATURES, "target_return_to_close"])
    + ")"
)
FEATURE_SPEC = " ".join(f"{c}:f" for c in schemas.SNAPSHOT_FEATURES)
SNAP_SPEC = f"ticker date:d ts:t {FEATURE_SPEC} price_now:f day_close:f target_return_to_close:f"
CTES = (EVENT_DAYS, INTRADAY, CONTEXT, RUNNING, SNAPS)
DAY_SPLIT = (
    "dd AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY date) AS dr FROM snaps), "
    "dn AS (SELECT *, max(dr) OVER (PARTITION BY ticker) AS dc FROM dd), "
    "sp AS (SELECT *, CASE WHEN dr > dc - greatest(dc * 15 // 100, 10) THEN 'test' ELSE 'train' END AS split, ret_last_bar * CAST(0.1 AS DOUBLE) AS prediction FROM dn)"
)
BUCKETS = (
    "CASE WHEN minutes_until_close > 0 AND minutes_until_close <= 60 THEN '<1h to close' WHEN minutes_until_close > 60 AND minutes_until_close <= 120 THEN '1-2h' "
    "WHEN minutes_until_close > 120 AND minutes_until_close <= 180 THEN '2-3h' WHEN minutes_until_close > 180 AND minutes_until_close <= 240 THEN '3-4h' "
    "WHEN minutes_until_close > 240 AND minutes_until_close <= 300 THEN '4-5h' WHEN minutes_until_close > 300 AND minutes_until_close <= 390 THEN '>5h to close' END"
)
LOCAL = "(ts - CASE WHEN ts < TIMESTAMP '2024-03-10 07:00:00' THEN INTERVAL 5 HOUR ELSE INTERVAL 4 HOUR END)"

QUERIES = {
    "intraday_context": intraday_context,
    "running_session": running_session,
    "intraday_snapshots": intraday_snapshots,
    "intraday_snapshots_with_last_bar": intraday_snapshots_with_last_bar,
    "live_snapshots": live_snapshots,
    "local_session_day": local_session_day,
    "day_split_counts": day_split_counts,
    "time_bucket_accuracy": time_bucket_accuracy,
    "intraday_model_metrics": intraday_model_metrics,
}

ORACLES = {
    "intraday_context": query(
        EVENT_DAYS, CONTEXT, emit("ctx", "ticker date:d prev_close:f prev_day_return:f avg_volume_20d:f")
    ),
    "running_session": query(
        INTRADAY,
        RUNNING,
        emit(
            "run",
            "ticker date:d ts:t bar_no:i n_bars:i day_open:f day_close:f price_now:f price_before:f high_so_far:f low_so_far:f volume_so_far:f",
        ),
    ),
    "intraday_snapshots": query(*CTES, emit("snaps", SNAP_SPEC)),
    "intraday_snapshots_with_last_bar": query(
        *CTES[:-1],
        SNAPS.replace("bar_no < n_bars", "bar_no <= n_bars"),
        emit("snaps", SNAP_SPEC),
    ),
    "live_snapshots": query(
        *CTES,
        "lv AS (SELECT *, ts AS as_of FROM snapall WHERE n_bars >= 2 AND bar_no = n_bars)",
        emit("lv", f"ticker date:d as_of:t {FEATURE_SPEC} price_now:f"),
    ),
    "local_session_day": query(
        f"l AS (SELECT event_type AS ticker, {LOCAL} AS ts FROM events)",
        "g AS (SELECT ticker, CAST(ts AS DATE) AS date, count(*) AS n, avg(greatest(960 - (hour(ts) * 3600 + minute(ts) * 60 + "
        "(date_part('microseconds', ts) / CAST(1000000 AS DOUBLE))) / 60, 0)) AS avg_minutes_left FROM l GROUP BY ALL)",
        emit("g", "ticker date:d n:i avg_minutes_left:f"),
    ),
    "day_split_counts": query(
        *CTES,
        DAY_SPLIT,
        "a AS (SELECT ticker, split, count(*) AS n_rows, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date FROM sp GROUP BY ALL)",
        emit("a", "ticker split n_rows:i n_days:i first_date:d last_date:d"),
    ),
    "time_bucket_accuracy": query(
        *CTES,
        DAY_SPLIT,
        f"b AS (SELECT *, {BUCKETS} AS bucket FROM sp WHERE split = 'test')",
        "a AS (SELECT ticker, bucket, count(*) AS n, avg(abs(prediction - target_return_to_close)) AS mae, "
        "avg(CASE WHEN sign(prediction) = sign(target_return_to_close) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy FROM b WHERE bucket IS NOT NULL GROUP BY ALL)",
        emit("a", "ticker bucket n:i mae:f directional_accuracy:f"),
    ),
    "intraday_model_metrics": query(
        *CTES,
        DAY_SPLIT,
        "a AS (SELECT ticker, sqrt(avg((prediction - target_return_to_close) ** 2)) AS rmse, avg(abs(prediction - target_return_to_close)) AS mae, "
        "avg(CASE WHEN sign(prediction) = sign(target_return_to_close) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy FROM sp WHERE split = 'test' GROUP BY 1)",
        emit("a", "ticker rmse:f mae:f directional_accuracy:f"),
    ),
}
