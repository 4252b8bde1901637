"""Daily technical features and targets of every instrument in one plan.

One exchange by ticker; all windows then share the sort by (ticker, block, row).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import dates, windows
from quaymark.functions.smoothing import Smooth, block_order, number_rows, smooth
from quaymark.operators import asof

RETURN_ROWS = (1, 2, 3, 5, 10)
MEAN_ROWS = (5, 10, 20, 50)
STD_ROWS = (5, 10, 20)
BAND_ROWS = 20
RSI_ROWS = 14


def price_windows(close: Column, spec) -> dict[str, Column]:
    """Helper columns that need the neighbours of a row; each window is computed once."""
    lags = {f"_lag_{k}": F.lag(close, k).over(spec) for k in RETURN_ROWS}
    means = {f"_mean_{k}": windows.rolling_mean(close, k, spec) for k in MEAN_ROWS}
    return lags | means | {"_std": windows.rolling_std(close, BAND_ROWS, spec)}


def price_columns(close: Column) -> dict[str, Column]:
    """Returns, moving-average ratios and Bollinger bands out of the helper columns."""
    mid, width = F.col(f"_mean_{BAND_ROWS}"), F.col("_std") * 4
    out = {f"ret_{k}d": F.try_divide(close, F.col(f"_lag_{k}")) - 1 for k in RETURN_ROWS}
    out |= {f"sma_{k}_ratio": F.try_divide(close, F.col(f"_mean_{k}")) - 1 for k in MEAN_ROWS}
    out["bb_position"] = F.try_divide(close - (mid - width / 2), width)
    out["bb_width"] = F.try_divide(width, mid)
    return out


def volume_columns(volume: Column, spec) -> dict[str, Column]:
    return {
        "vol_change": windows.change(volume, 1, spec),
        "vol_ratio_20d": F.try_divide(volume, windows.rolling_mean(volume, 20, spec)),
    }


def day_columns() -> dict[str, Column]:
    return {
        "hl_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "dow_sin": dates.weekday_sin(F.col("date")),
        "dow_cos": dates.weekday_cos(F.col("date")),
    }


def relative_strength(gain: Column, loss: Column) -> Column:
    """0..100 from smoothed gains and losses; 50 while warming up and when nothing was lost."""
    ready = F.col("_i") >= RSI_ROWS
    ratio = F.try_divide(gain, loss)
    return F.coalesce(F.when(ready, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio)), F.lit(50.0))


def own_features(bars: DataFrame, *more: str) -> DataFrame:
    """(ticker, date, 23 features, target_return, target_direction, close); ``more`` keys split instruments further."""
    keys = ("ticker", *more)
    spec = block_order(*keys)
    close, volume = F.col("close"), F.col("volume")

    frame = number_rows(bars.select(*schemas.DAILY_BARS.fieldNames(), *more), *keys)
    frame = frame.withColumns(price_windows(close, spec) | volume_columns(volume, spec))
    move = close - F.col("_lag_1")
    frame = frame.withColumns(
        price_columns(close)
        | day_columns()
        | {"_gain": F.greatest(move, F.lit(0.0)), "_loss": F.greatest(-move, F.lit(0.0))}
    )
    ret = F.col("ret_1d")
    frame = frame.withColumns(
        {f"vol_{k}d": windows.rolling_std(ret, k, spec) for k in STD_ROWS}
        | {"target_return": F.lead(ret, 1).over(spec)}
    )
    frame = smooth(
        frame,
        {
            "_fast": Smooth("close", 2 / 13),
            "_slow": Smooth("close", 2 / 27),
            "_up": Smooth("_gain", 1 / RSI_ROWS, seed_row=1),
            "_down": Smooth("_loss", 1 / RSI_ROWS, seed_row=1),
        },
        *keys,
    ).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    frame = smooth(frame, {"_signal": Smooth("_macd", 2 / 10)}, *keys)
    frame = frame.withColumns(
        {
            "rsi_14": relative_strength(F.col("_up"), F.col("_down")),
            "macd": F.try_divide("_macd", close),
            "macd_signal": F.try_divide("_signal", close),
            "macd_hist": F.try_divide(F.col("_macd") - F.col("_signal"), close),
            "target_direction": (F.col("target_return") > 0).cast("int"),
        }
    )
    return frame.select(
        *keys, "date", *schemas.OWN_FEATURES, "target_return", "target_direction", "close"
    )


def feature_table(bars: DataFrame, macro: DataFrame | None = None, news: DataFrame | None = None) -> DataFrame:
    """Own features with the date-level macro block and the per-ticker news block aligned to them."""
    frame = own_features(bars)
    if macro is not None:
        frame = asof.align_shared(frame, macro, [c for c in macro.columns if c != "date"])
    if news is not None:
        frame = asof.align_per_entity(
            frame, news, [c for c in news.columns if c not in ("ticker", "date")], "ticker"
        )
    return frame


def complete_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every listed column present; NaN counts as missing."""
    return frame.na.drop(subset=columns)


def dataset(features: DataFrame, columns: list[str]) -> DataFrame:
    """Model-ready rows: the chosen feature columns, both targets and the close, none missing."""
    kept = complete_rows(features, [*columns, "target_return", "target_direction"])
    return kept.select("ticker", "date", *columns, "target_return", "target_direction", "close")


def latest_complete(features: DataFrame, columns: list[str]) -> DataFrame:
    """Each instrument's newest row with every listed column present."""
    kept = complete_rows(features, columns)
    rest = [c for c in kept.columns if c != "ticker"]
    newest = F.max_by(F.struct(*rest), "date").alias("_row")
    return kept.groupBy("ticker").agg(newest).select("ticker", "_row.*")
