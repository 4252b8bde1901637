"""Session-to-date snapshots: one row per bar of a trading day, using only bars up to it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.functions import dates, windows
from quaymark.operators.features import complete_rows


def day_context(daily: DataFrame) -> DataFrame:
    """Per day: previous close, previous return and typical volume, none of them of the day itself."""
    spec = windows.calendar("ticker")
    measured = daily.select("ticker", "date", "close", "volume").withColumns(
        {
            "_ret": windows.change(F.col("close"), 1, spec),
            "_typical": windows.rolling_mean(F.col("volume"), 20, spec),
        }
    )
    return measured.select(
        "ticker",
        "date",
        F.lag("close", 1).over(spec).alias("prev_close"),
        F.lag("_ret", 1).over(spec).alias("prev_day_return"),
        F.lag("_typical", 1).over(spec).alias("avg_volume_20d"),
    )


def running_session(bars: DataFrame, *keep: str) -> DataFrame:
    """Running statistics of each session. Groups are single sessions, so they stay small."""
    session = Window.partitionBy("ticker", "date")
    ordered = session.orderBy("ts")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bars.select(
        "ticker",
        "date",
        "ts",
        *keep,
        F.row_number().over(ordered).alias("bar_no"),
        F.count(F.lit(1)).over(whole).alias("n_bars"),
        F.first("open").over(so_far).alias("day_open"),
        F.last("close").over(whole).alias("day_close"),
        F.col("close").alias("price_now"),
        F.lag("close", 1).over(ordered).alias("price_before"),
        F.max("high").over(so_far).alias("high_so_far"),
        F.min("low").over(so_far).alias("low_so_far"),
        F.sum("volume").over(so_far).alias("volume_so_far"),
    )


def snapshot_features(running: DataFrame, context: DataFrame) -> DataFrame:
    """The 11 snapshot features for running session rows with a known previous close."""
    joined = running.join(context.where(F.col("prev_close").isNotNull()), ["ticker", "date"])
    price, span = F.col("price_now"), F.col("high_so_far") - F.col("low_so_far")
    left = dates.minutes_until_close(F.col("ts"))
    elapsed = F.lit(1.0) - left / config.SESSION_MINUTES
    typical = F.when(elapsed > 0, F.col("avg_volume_20d") * elapsed)
    return joined.withColumns(
        {
            "minutes_until_close": left,
            "frac_of_day_elapsed": elapsed,
            "ret_since_open": F.try_divide(price, F.col("day_open")) - 1,
            "ret_last_bar": F.try_divide(price, F.col("price_before")) - 1,
            "pos_in_range": F.when(span > 0, F.try_divide(price - F.col("low_so_far"), span)).otherwise(0.5),
            "range_so_far_pct": F.try_divide(span, price),
            "gap_from_prev_close": F.try_divide(F.col("day_open"), F.col("prev_close")) - 1,
            "vol_ratio_vs_typical": F.when(typical > 0, F.try_divide(F.col("volume_so_far"), typical)),
            "dow_sin": dates.weekday_sin(F.col("ts")),
            "dow_cos": dates.weekday_cos(F.col("ts")),
        }
    )


def with_session_day(bars: DataFrame, zone: str | None = None) -> DataFrame:
    """Local time and trading day; ``zone`` converts instants held in UTC."""
    if zone:
        bars = bars.withColumn("ts", dates.local_time(F.col("ts"), zone))
    return bars.withColumn("date", F.to_date("ts"))


def snapshots(
    bars: DataFrame, daily: DataFrame, zone: str | None = None, include_last_bar: bool = False
) -> DataFrame:
    """Training snapshots: sessions of 3+ bars, from the second bar on, target = return to the close."""
    running = running_session(with_session_day(bars, zone))
    last = F.col("n_bars") if include_last_bar else F.col("n_bars") - 1
    usable = running.where(
        (F.col("n_bars") >= config.MIN_SESSION_BARS) & (F.col("bar_no") >= 2) & (F.col("bar_no") <= last)
    )
    frame = snapshot_features(usable, day_context(daily)).withColumn(
        "target_return_to_close", F.try_divide("day_close", "price_now") - 1
    )
    frame = complete_rows(frame, [*schemas.SNAPSHOT_FEATURES, "target_return_to_close"])
    return frame.select(
        "ticker", "date", "ts", *schemas.SNAPSHOT_FEATURES, "price_now", "day_close", "target_return_to_close"
    )


def live_snapshots(bars: DataFrame, daily: DataFrame, zone: str | None = None) -> DataFrame:
    """One row per (ticker, session) as of its newest bar; needs two bars and a previous close."""
    running = running_session(with_session_day(bars, zone))
    newest = running.where((F.col("n_bars") >= 2) & (F.col("bar_no") == F.col("n_bars")))
    return snapshot_features(newest, day_context(daily)).select(
        "ticker", "date", F.col("ts").alias("as_of"), *schemas.SNAPSHOT_FEATURES, "price_now"
    )


def time_bucket(minutes_left):
    """Right-closed bucket of the time to the close; NULL outside (0, 390]."""
    label = None
    for low, high, name in config.TIME_BUCKETS:
        inside = (minutes_left > low) & (minutes_left <= high)
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    return label


def accuracy_by_time(scored: DataFrame, *keys: str) -> DataFrame:
    """n, MAE and sign accuracy per time-to-close bucket. Needs ``prediction``."""
    target = F.col("target_return_to_close")
    hit = (F.signum("prediction") == F.signum(target)).cast("double")
    frame = scored.withColumn("bucket", time_bucket(F.col("minutes_until_close"))).where(F.col("bucket").isNotNull())
    return frame.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("prediction") - target)).alias("mae"),
        F.avg(hit).alias("directional_accuracy"),
    )
