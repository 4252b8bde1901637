"""Bar tables, the outage guard and own features."""

from pyspark.sql import functions as F

from catalogue.common import (
    BARS, INTRADAY, MACRO, MARKET, change, emit, portable, query, rolling,
)
from quaymark import schemas
from quaymark.functions import windows
from quaymark.operators import features
from quaymark.sources import bars as bar_source
from quaymark.sources import derived

BAR_SPEC = "ticker date:d open:f high:f low:f close:f volume:f"


def daily_bars(spark, folder):
    return portable(derived.daily_bars(spark, folder))


def market_bars(spark, folder):
    return portable(derived.market_bars(spark, folder))


def macro_bars(spark, folder):
    return portable(derived.macro_bars(spark, folder))


def intraday_bars(spark, folder):
    return portable(derived.intraday_bars(spark, folder))


def bars_long_table(spark, folder):
    frames = {"SEGMENTS": derived.daily_bars(spark, folder), "INDEX": derived.market_bars(spark, folder)}
    together = bar_source.collect_series(frames, "origin")
    return portable(
        together.groupBy("origin", "ticker").agg(
            F.count(F.lit(1)).alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
        )
    )


def macro_last_per_day(spark, folder):
    """Several prints per series and day; the last one counts."""
    lines = derived.table(spark, folder, "lineitem")
    prints = lines.select(
        F.col("l_returnflag").alias("series"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("close"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "close")
    return portable(bar_source.latest_per_day(prints, tie, "series", "date").select("series", "date", "close"))


def settled_bars(spark, folder):
    """Bars whose close is withheld every tenth order day count as unsettled."""
    bars = derived.daily_bars(spark, folder)
    holes = bars.withColumn("close", F.when(F.dayofmonth("date") % 10 != 0, F.col("close")))
    return portable(bar_source.settled(holes))


def outage_guard_merge(spark, folder):
    """One segment comes back with few rows (kept as cached), the others complete but revised."""
    cached = derived.daily_bars(spark, folder)
    broken = (F.col("ticker") == "BUILDING") & (F.year("date") > 1992)
    incoming = cached.where(~broken).withColumn("volume", F.col("volume") + 1)
    return portable(bar_source.guard_outage(cached, incoming))


def _features(*columns):
    def run(spark, folder):
        return portable(features.own_features(derived.daily_bars(spark, folder)).select("ticker", "date", *columns))

    return run


def _windowed(spark, folder, make):
    bars = derived.daily_bars(spark, folder)
    return bars.select("ticker", "date", *[c.alias(n) for n, c in make(windows.calendar("ticker")).items()])


RETURNS = [f"ret_{k}d" for k in features.RETURN_ROWS]
SMAS = [f"sma_{k}_ratio" for k in features.MEAN_ROWS]


def _prices(*columns):
    """Price features without the smoothed ones."""

    def run(spark, folder):
        bars = derived.daily_bars(spark, folder).select("ticker", "date", "close")
        close = F.col("close")
        frame = bars.withColumns(features.price_windows(close, windows.calendar("ticker")))
        frame = frame.withColumns(features.price_columns(close))
        return portable(frame.select("ticker", "date", *columns))

    return run


def volume_features(spark, folder):
    return portable(_windowed(spark, folder, lambda w: features.volume_columns(F.col("volume"), w)))


def hl_range_dow(spark, folder):
    bars = derived.daily_bars(spark, folder)
    return portable(bars.select("ticker", "date", *[c.alias(n) for n, c in features.day_columns().items()]))


def own_feature_dataset(spark, folder):
    frame = features.own_features(derived.daily_bars(spark, folder))
    return portable(features.dataset(frame, schemas.OWN_FEATURES))


def latest_complete_row(spark, folder):
    frame = features.own_features(derived.daily_bars(spark, folder))
    return portable(features.latest_complete(frame, schemas.OWN_FEATURES).select("ticker", "date", *schemas.OWN_FEATURES, "close"))


MID = rolling("avg", "close", 20)
SD = rolling("stddev_samp", "close", 20)
MEAN_VOLUME = rolling("avg", "volume", 20)
RET1 = f"ret AS (SELECT *, {change('close', 1)} AS ret_1d FROM bars)"
DOW = "(isodow(date) - 1) * (2 * pi() / 5)"
# Exponential smoothing by direct recursion over the row number.
EMA = (
    "idx AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, "
    "greatest(close - lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS gain, "
    "greatest(lag(close) OVER (PARTITION BY ticker ORDER BY date) - close, 0) AS loss FROM bars), "
    "ema AS (SELECT ticker, i, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig, "
    "CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down FROM idx WHERE i = 0 UNION ALL "
    "SELECT b.ticker, b.i, e12 + (b.close - e12) * (2.0::DOUBLE / 13), e26 + (b.close - e26) * (2.0::DOUBLE / 27), "
    "sig + ((e12 + (b.close - e12) * (2.0::DOUBLE / 13)) - (e26 + (b.close - e26) * (2.0::DOUBLE / 27)) - sig) * (2.0::DOUBLE / 10), "
    "CASE WHEN b.i = 1 THEN b.gain ELSE up + (b.gain - up) / 14 END, "
    "CASE WHEN b.i = 1 THEN b.loss ELSE down + (b.loss - down) / 14 END "
    "FROM ema JOIN idx b ON b.ticker = ema.ticker AND b.i = ema.i + 1)"
)
OWN = (
    "own AS (SELECT r.ticker, r.date, r.close, ret_1d, "
    + ", ".join(f"{change('close', k)} AS ret_{k}d" for k in (2, 3, 5, 10))
    + ", "
    + ", ".join(f"close / {rolling('avg', 'close', k)} - 1 AS sma_{k}_ratio" for k in (5, 10, 20, 50))
    + ", "
    + ", ".join(f"{rolling('stddev_samp', 'ret_1d', k)} AS vol_{k}d" for k in (5, 10, 20))
    + f", (close - ({MID} - 2 * {SD})) / nullif(4 * {SD}, 0) AS bb_position, 4 * {SD} / {MID} AS bb_width, "
    f"{change('volume', 1)} AS vol_change, volume / {MEAN_VOLUME} AS vol_ratio_20d, (high - low) / close AS hl_range, "
    f"sin({DOW}) AS dow_sin, cos({DOW}) AS dow_cos, "
    "lead(ret_1d) OVER (PARTITION BY ticker ORDER BY date) AS target_return, "
    "row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM ret r), "
    "feat AS (SELECT own.*, CASE WHEN target_return IS NULL THEN NULL WHEN target_return > 0 THEN 1 ELSE 0 END AS target_direction, "
    "coalesce(CASE WHEN own.i >= 14 THEN 100 - 100 / (1 + up / nullif(down, 0)) END, 50) AS rsi_14, "
    "(e12 - e26) / close AS macd, sig / close AS macd_signal, (e12 - e26 - sig) / close AS macd_hist "
    "FROM own JOIN ema ON own.ticker = ema.ticker AND own.i = ema.i)"
)
FEATURE_CTES = (BARS, RET1, EMA, OWN)
COMPLETE_OWN = " AND ".join(f"{c} IS NOT NULL" for c in schemas.OWN_FEATURES)
OWN_SPEC = " ".join(f"{c}:f" for c in schemas.OWN_FEATURES)


def _feature_sql(*columns):
    kinds = " ".join(f"{c}:{'i' if c == 'target_direction' else 'f'}" for c in columns)
    return query(*FEATURE_CTES, emit("feat", f"ticker date:d {kinds}"))


QUERIES = {
    "daily_bars": daily_bars,
    "market_bars": market_bars,
    "macro_bars": macro_bars,
    "intraday_bars": intraday_bars,
    "bars_long_table": bars_long_table,
    "macro_last_per_day": macro_last_per_day,
    "settled_bars": settled_bars,
    "outage_guard_merge": outage_guard_merge,
    "returns_multi": _prices(*RETURNS),
    "sma_ratios": _prices(*SMAS),
    "rolling_vol": _features("vol_5d", "vol_10d", "vol_20d"),
    "bollinger": _prices("bb_position", "bb_width"),
    "volume_features": volume_features,
    "hl_range_dow": hl_range_dow,
    "rsi_14": _features("rsi_14"),
    "macd": _features("macd", "macd_signal", "macd_hist"),
    "next_day_targets": _features("ret_1d", "target_return", "target_direction"),
    "own_feature_dataset": own_feature_dataset,
    "latest_complete_row": latest_complete_row,
}

ORACLES = {
    "daily_bars": query(BARS, emit("bars", BAR_SPEC)),
    "market_bars": query(MARKET, emit("market", BAR_SPEC)),
    "macro_bars": query(MACRO, emit("macro", "series date:d close:f")),
    "intraday_bars": query(INTRADAY, emit("ibars", "ticker ts:t open:f high:f low:f close:f volume:f")),
    "bars_long_table": query(
        BARS,
        MARKET,
        "t AS (SELECT 'SEGMENTS' AS origin, ticker, date FROM bars UNION ALL SELECT 'INDEX', ticker, date FROM market)",
        "g AS (SELECT origin, ticker, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date FROM t GROUP BY ALL)",
        emit("g", "origin ticker n_bars:i first_date:d last_date:d"),
    ),
    "macro_last_per_day": query(
        "r AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, row_number() OVER "
        "(PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, "
        "l_extendedprice DESC) AS k FROM lineitem)",
        emit("r", "series date:d close:f") + " WHERE k = 1",
    ),
    "settled_bars": query(BARS, emit("bars", BAR_SPEC) + " WHERE day(bars.date) % 10 <> 0"),
    "outage_guard_merge": query(
        BARS,
        "fresh AS (SELECT * REPLACE (volume + 1 AS volume) FROM bars WHERE NOT (ticker = 'BUILDING' AND year(date) > 1992))",
        "c AS (SELECT ticker, count(*) AS n FROM bars GROUP BY 1), f AS (SELECT ticker, count(*) AS n FROM fresh GROUP BY 1)",
        "keep AS (SELECT c.ticker FROM c LEFT JOIN f ON c.ticker = f.ticker WHERE f.n IS NULL OR (c.n > 20 AND f.n < c.n / 2))",
        "m AS (SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM keep) UNION ALL "
        "SELECT * FROM fresh WHERE ticker NOT IN (SELECT ticker FROM keep))",
        emit("m", BAR_SPEC),
    ),
    "returns_multi": _feature_sql(*RETURNS),
    "sma_ratios": _feature_sql(*SMAS),
    "rolling_vol": _feature_sql("vol_5d", "vol_10d", "vol_20d"),
    "bollinger": _feature_sql("bb_position", "bb_width"),
    "volume_features": _feature_sql("vol_change", "vol_ratio_20d"),
    "hl_range_dow": _feature_sql("hl_range", "dow_sin", "dow_cos"),
    "rsi_14": _feature_sql("rsi_14"),
    "macd": _feature_sql("macd", "macd_signal", "macd_hist"),
    "next_day_targets": _feature_sql("ret_1d", "target_return", "target_direction"),
    "own_feature_dataset": query(
        *FEATURE_CTES,
        emit("feat", f"ticker date:d {OWN_SPEC} target_return:f target_direction:i close:f")
        + f" WHERE {COMPLETE_OWN} AND target_return IS NOT NULL",
    ),
    "latest_complete_row": query(
        *FEATURE_CTES,
        f"r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM feat WHERE {COMPLETE_OWN})",
        emit("r", f"ticker date:d {OWN_SPEC} close:f") + " WHERE k = 1",
    ),
}
