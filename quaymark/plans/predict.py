"""Prediction rows: next day, rest of today."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import labels
from quaymark.models import linear
from quaymark.operators import intraday
from quaymark.operators.features import latest_complete


def next_day(
    scored: DataFrame, pulse: DataFrame | None = None, implied_vol: DataFrame | None = None
) -> DataFrame:
    """The newest day each instrument's own models can read, with live context beside it.

    ``pulse`` and ``implied_vol`` are context keyed by ticker; they are never model inputs.
    """
    newest = latest_complete(scored.where("complete"), ["pred_return", "up_probability", "close"])
    rows = newest.select(
        "ticker",
        F.col("date").alias("last_close_date"),
        F.col("close").alias("last_close"),
        (F.col("pred_return") * 100).alias("predicted_return_pct"),
        labels.predicted_price(F.col("close"), F.col("pred_return")).alias("predicted_next_close"),
        labels.direction(F.col("up_probability")).alias("predicted_direction"),
        "up_probability",
    )
    if pulse is not None:
        rows = rows.join(pulse.select("ticker", F.col("label").alias("live_news_sentiment")), "ticker", "left")
    if implied_vol is not None:
        context = implied_vol.select(
            "ticker", F.col("atm_iv").alias("live_atm_iv"), F.col("iv_skew").alias("live_iv_skew")
        )
        rows = rows.join(context, "ticker", "left")
    return rows


def status_text(minutes_left: Column) -> Column:
    open_text = F.format_string("%d min until close", F.bround(minutes_left).cast("long"))
    return F.when(minutes_left <= 0, F.lit("closed for the day")).otherwise(open_text)


def todays_close(
    bars: DataFrame, daily: DataFrame, coefficients: DataFrame, today: Column, zone: str | None = None
) -> DataFrame:
    """One status row per instrument: closed, too few bars, or the estimate as of its newest bar."""
    located = intraday.with_session_day(bars, zone)
    sessions = located.groupBy("ticker").agg(
        F.max_by("close", "ts").alias("last_session_close"),
        F.max(F.when(F.col("date") == today, F.col("ts"))).alias("newest_ts"),
        F.max_by("close", F.when(F.col("date") == today, F.col("ts"))).alias("newest_close"),
    )
    now = intraday.live_snapshots(located.where(F.col("date") == today), daily)
    estimated = linear.score_linear(now, coefficients, schemas.SNAPSHOT_FEATURES, "pred", "ticker").select(
        "ticker", "as_of", "price_now", "minutes_until_close", "pred"
    )
    joined = sessions.join(estimated, "ticker", "left")
    closed, live = F.col("newest_ts").isNull(), F.col("as_of").isNotNull()
    status = (
        F.when(closed, F.lit("market closed (no bars yet today)"))
        .when(live, status_text(F.col("minutes_until_close")))
        .otherwise(F.lit("not enough bars yet this session (try again in a few minutes)"))
    )
    return joined.select(
        "ticker",
        status.alias("status"),
        F.col("newest_ts").alias("as_of"),
        F.col("newest_close").alias("current_price"),
        F.when(live, labels.predicted_price(F.col("price_now"), F.col("pred"))).alias("predicted_4pm_close"),
        F.when(live, F.col("pred") * 100).alias("predicted_change_pct"),
        F.when(closed, F.col("last_session_close")).alias("last_session_close"),
    )
