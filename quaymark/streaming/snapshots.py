"""Session-to-date snapshots and their scoring on a stream of bars."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaymark import schemas
from quaymark.models import linear
from quaymark.operators import intraday

STATE = (
    "bar_no long, day_open double, price_before double, price_now double, high double, low double, volume double, ts timestamp"
)
RUNNING = (
    "ticker string, date date, ts timestamp, bar_no long, day_open double, price_before double, price_now double, "
    "high_so_far double, low_so_far double, volume_so_far double"
)


def _advance(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new bars of one session into its eight running numbers; a passed close clears them."""
    if state.hasTimedOut:
        state.remove()
        return
    held = state.getOption
    number, day_open, _, now, high, low, volume, _ = held if held else (0, None, None, None, None, None, 0.0, None)
    # A call's rows can come in several chunks in any order: sort all of them once. A session has few bars.
    bars = pd.concat(list(chunks), ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)
    if bars.empty:
        return
    out = pd.DataFrame(
        {
            "ticker": key[0], "date": key[1], "ts": bars["ts"], "bar_no": number + 1 + bars.index,
            "day_open": bars["open"].iloc[0] if day_open is None else day_open,
            "price_before": bars["close"].shift(1, fill_value=float("nan") if now is None else now), "price_now": bars["close"],
            "high_so_far": bars["high"].cummax().clip(lower=high), "low_so_far": bars["low"].cummin().clip(upper=low),
            "volume_so_far": bars["volume"].cumsum() + volume,
        }
    )
    yield out
    last = out.iloc[-1]
    state.update(
        (
            int(last["bar_no"]), float(last["day_open"]), None if pd.isna(last["price_before"]) else float(last["price_before"]),
            float(last["price_now"]), float(last["high_so_far"]), float(last["low_so_far"]), float(last["volume_so_far"]),
            last["ts"].to_pydatetime(),
        )
    )
    close = pd.Timestamp(key[1]) + pd.Timedelta(hours=16)
    if close.timestamp() * 1000 > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(int(close.timestamp() * 1000))


def running_sessions(bars: DataFrame) -> DataFrame:
    """Running session rows for a stream of in-order bars inside trading hours.

    State is keyed by (ticker, session day) and holds eight numbers whatever the number of bars.
    """
    minute = F.hour("ts") * 60 + F.minute("ts")
    inside = bars.where((minute >= 570) & (minute < 960)).withColumn("date", F.to_date("ts"))
    return inside.groupBy("ticker", "date").applyInPandasWithState(
        _advance, RUNNING, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def snapshot_stream(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Snapshot features of every bar from the second on, joined with the static day context."""
    running = running_sessions(bars).where(F.col("bar_no") >= 2)
    framed = intraday.snapshot_features(running, intraday.day_context(daily))
    return framed.select("ticker", "date", "ts", *schemas.SNAPSHOT_FEATURES, "price_now")


def scored_stream(bars: DataFrame, daily: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Snapshots with the estimated close of the day."""
    rows = linear.score_linear(
        snapshot_stream(bars, daily), coefficients, schemas.SNAPSHOT_FEATURES, "prediction", "ticker"
    )
    return rows.withColumn("predicted_close", F.col("price_now") * (1 + F.col("prediction")))
