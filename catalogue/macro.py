"""Cross-market features and as-of alignment."""

from catalogue.bars import FEATURE_CTES
from catalogue.common import BARS, MACRO, change, emit, portable, query, rolling
from quaymark import schemas
from quaymark.operators import asof, features, macro
from quaymark.session import settle
from quaymark.sources import derived

MACRO_SPEC = " ".join(f"{c}:f" for c in schemas.MACRO_FEATURES)


def macro_series_measures(spark, folder):
    return portable(
        macro.series_measures(derived.macro_bars(spark, folder)).select(
            "series", "date", "close", "ret", "step_bp", "zscore", "ret_std"
        )
    )


def macro_cross_series(spark, folder):
    return portable(macro.spreads(macro.series_measures(derived.macro_bars(spark, folder))))


def macro_features(spark, folder):
    return portable(macro.macro_features(derived.macro_bars(spark, folder)))


def asof_align_macro(spark, folder):
    bars = settle(derived.daily_bars(spark, folder).select("ticker", "date", "close"))
    block = macro.macro_features(derived.macro_bars(spark, folder))
    return portable(asof.align_shared(bars, block, schemas.MACRO_FEATURES))


def macro_feature_dataset(spark, folder):
    frame = features.feature_table(
        settle(derived.daily_bars(spark, folder)), macro.macro_features(derived.macro_bars(spark, folder))
    )
    columns = schemas.FEATURE_SETS["with_macro"]
    return portable(features.dataset(frame, columns))


def _measure(series: str, column: str) -> str:
    return f"(SELECT date, {column} AS v FROM meas WHERE series = '{series}')"


MEASURES = (
    f"mret AS (SELECT *, {change('close', 1, 'series')} AS ret FROM macro), "
    f"meas AS (SELECT *, (close - lag(close) OVER (PARTITION BY series ORDER BY date)) * 10 AS step_bp, "
    f"(close - {rolling('avg', 'close', 60, 'series')}) / nullif({rolling('stddev_samp', 'close', 60, 'series')}, 0) AS zscore, "
    f"{rolling('stddev_samp', 'ret', 10, 'series')} AS ret_std FROM mret)"
)
SPREADS = (
    "curve AS (SELECT date, a.v - b.v AS value, a.v - b.v - lag(a.v - b.v) OVER (ORDER BY date) AS step FROM "
    + _measure("TNX", "close") + " a FULL JOIN " + _measure("IRX", "close") + " b USING (date)), "
    "credit AS (SELECT date, a.v - b.v AS value, a.v - b.v - lag(a.v - b.v) OVER (ORDER BY date) AS step FROM "
    + _measure("HYG", "ret") + " a FULL JOIN " + _measure("IEF", "ret") + " b USING (date))"
)


def _wide() -> str:
    select, joins = [], []
    for k, (name, (series, column)) in enumerate(macro.SERIES_FEATURES.items()):
        select.append(f"s{k}.v AS {name}")
        joins.append(f"LEFT JOIN {_measure(series, column)} s{k} ON s{k}.date = d.date")
    return (
        "mfeat AS (SELECT d.date, "
        + ", ".join(select)
        + ", curve.value AS yield_curve_slope, curve.step * 10 AS yield_curve_chg_1d_bp, "
        "credit.value AS credit_stress, credit.step AS credit_stress_chg_1d "
        "FROM (SELECT date FROM macro WHERE series = 'VIX') d "
        + " ".join(joins)
        + " LEFT JOIN curve ON curve.date = d.date LEFT JOIN credit ON credit.date = d.date)"
    )


MACRO_CTES = (MACRO, MEASURES, SPREADS, _wide())
ALIGNED = (
    "cal AS (SELECT date FROM mfeat UNION SELECT date FROM bars), carried AS (SELECT cal.date, "
    + ", ".join(
        f"last_value(m.{c} IGNORE NULLS) OVER (ORDER BY cal.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in schemas.MACRO_FEATURES
    )
    + " FROM cal LEFT JOIN mfeat m ON m.date = cal.date)"
)
ENHANCED = "enh AS (SELECT feat.*, carried.* EXCLUDE (date) FROM feat LEFT JOIN carried ON carried.date = feat.date)"

QUERIES = {
    "macro_series_measures": macro_series_measures,
    "macro_cross_series": macro_cross_series,
    "macro_features": macro_features,
    "asof_align_macro": asof_align_macro,
    "macro_feature_dataset": macro_feature_dataset,
}

ORACLES = {
    "macro_series_measures": query(
        MACRO, MEASURES, emit("meas", "series date:d close:f ret:f step_bp:f zscore:f ret_std:f")
    ),
    "macro_cross_series": query(
        MACRO,
        MEASURES,
        SPREADS,
        "s AS (SELECT 'yield_curve' AS spread, * FROM curve UNION ALL SELECT 'credit_stress', * FROM credit)",
        emit("s", "spread date:d value:f step:f"),
    ),
    "macro_features": query(*MACRO_CTES, emit("mfeat", f"date:d {MACRO_SPEC}")),
    "asof_align_macro": query(
        BARS,
        *MACRO_CTES,
        ALIGNED,
        "a AS (SELECT bars.ticker, bars.date, bars.close, carried.* EXCLUDE (date) FROM bars LEFT JOIN carried ON carried.date = bars.date)",
        emit("a", f"ticker date:d close:f {MACRO_SPEC}"),
    ),
    "macro_feature_dataset": query(
        *FEATURE_CTES,
        *MACRO_CTES,
        ALIGNED,
        ENHANCED,
        emit(
            "enh",
            "ticker date:d "
            + " ".join(f"{c}:f" for c in schemas.FEATURE_SETS["with_macro"])
            + " target_return:f target_direction:i close:f",
        )
        + " WHERE target_return IS NOT NULL AND "
        + " AND ".join(f"{c} IS NOT NULL" for c in schemas.FEATURE_SETS["with_macro"]),
    ),
}
