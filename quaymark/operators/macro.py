"""Cross-market features: long series in, one row per day of the lead series out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import windows

CALENDAR_SERIES = "VIX"
Z_ROWS = 60
VOL_ROWS = 10
# Feature -> (series, measure).
SERIES_FEATURES = {
    "vix_level": ("VIX", "close"),
    "vix_zscore": ("VIX", "zscore"),
    "vix_ret_1d": ("VIX", "ret"),
    "tnx_level": ("TNX", "close"),
    "tnx_chg_1d_bp": ("TNX", "step_bp"),
    "dxy_ret_1d": ("DXY", "ret"),
    "oil_ret_1d": ("OIL", "ret"),
    "oil_vol_10d": ("OIL", "ret_std"),
    "gold_ret_1d": ("GOLD", "ret"),
    "dji_ret_1d": ("DJI", "ret"),
    "ixic_ret_1d": ("IXIC", "ret"),
    "rut_ret_1d": ("RUT", "ret"),
    "qqq_ret_1d": ("QQQ", "ret"),
    "nikkei_ret_1d": ("NIKKEI", "ret"),
    "ftse_ret_1d": ("FTSE", "ret"),
    "dax_ret_1d": ("DAX", "ret"),
    "btc_ret_1d": ("BTC", "ret"),
    "btc_vol_10d": ("BTC", "ret_std"),
    "vxn_level": ("VXN", "close"),
    "vxn_zscore": ("VXN", "zscore"),
    "vxn_ret_1d": ("VXN", "ret"),
}
# Spread -> (plus series, minus series, measure).
SPREADS = {
    "yield_curve": ("TNX", "IRX", "close"),
    "credit_stress": ("HYG", "IEF", "ret"),
}


def series_measures(macro_bars: DataFrame, *by: str) -> DataFrame:
    """Per series and day, on the series' own calendar: ret, step_bp, zscore, ret_std."""
    spec = windows.calendar(*by, "series")
    close, ret = F.col("close"), F.col("ret")
    frame = macro_bars.select(*by, "series", "date", "close").withColumns(
        {
            "ret": windows.change(close, 1, spec),
            "step_bp": windows.step(close, spec) * 10,
            "zscore": windows.zscore(close, Z_ROWS, spec),
        }
    )
    return frame.withColumn("ret_std", windows.rolling_std(ret, VOL_ROWS, spec))


def spreads(measures: DataFrame, *by: str) -> DataFrame:
    """(spread, date, value, step): difference of two series on the union of their days.

    NULL where either side is absent; the day-to-day step runs on that union.
    """
    leg = F.array(
        *[
            F.when(
                F.col("series").isin(plus, minus),
                F.struct(
                    F.lit(name).alias("spread"),
                    F.when(F.col("series") == plus, F.col(measure)).otherwise(-F.col(measure)).alias("signed"),
                ),
            )
            for name, (plus, minus, measure) in SPREADS.items()
        ]
    )
    legs = measures.select(*by, "date", F.explode(F.array_compact(leg)).alias("leg"))
    value = F.when(F.count("leg.signed") == 2, F.sum("leg.signed"))
    daily = legs.groupBy(*by, F.col("leg.spread").alias("spread"), "date").agg(value.alias("value"))
    return daily.withColumn("step", windows.step(F.col("value"), windows.calendar(*by, "spread")))


def macro_features(macro_bars: DataFrame, *by: str) -> DataFrame:
    """(date, 25 features) on the calendar of the lead series, per group of ``by``.

    The series are read once: measures per series, one row per day, then the day-to-day steps of the
    spreads over the days on which either side traded.
    """

    def pick(series: str, measure: str) -> Column:
        return F.max(F.when(F.col("series") == series, F.col(measure)))

    columns = {name: pick(series, measure) for name, (series, measure) in SERIES_FEATURES.items()}
    columns["_open"] = F.count_if(F.col("series") == CALENDAR_SERIES) > 0
    for name, (plus, minus, measure) in SPREADS.items():
        columns[name] = pick(plus, measure) - pick(minus, measure)
        columns[f"_{name}_day"] = F.count_if(F.col("series").isin(plus, minus)) > 0
    wide = series_measures(macro_bars, *by).groupBy(*by, "date").agg(*[c.alias(n) for n, c in columns.items()])

    def daily_step(name: str) -> Column:
        days = windows.calendar(*by, f"_{name}_day")
        return F.when(F.col(f"_{name}_day"), windows.step(F.col(name), days))

    stepped = wide.withColumns(
        {
            "yield_curve_slope": F.col("yield_curve"),
            "yield_curve_chg_1d_bp": daily_step("yield_curve") * 10,
            "credit_stress_chg_1d": daily_step("credit_stress"),
        }
    )
    return stepped.where("_open").select(*by, "date", *schemas.MACRO_FEATURES)
