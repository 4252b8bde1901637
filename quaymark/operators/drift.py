"""Long-horizon drift: forward returns, hit rates, window checks and live forecasts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config
from quaymark.functions import dates, labels, weights
from quaymark.operators import estimators, prior


def forward_panel(bars: DataFrame, horizons: dict[str, int], *keys: str) -> DataFrame:
    """One row per bar and horizon: position, exit price and exit date ``h`` rows later.

    All horizons are leads over one sort; the explode comes last.
    """
    group = Window.partitionBy(*keys)
    spec = group.orderBy("date")
    exits = F.array(
        *[
            F.struct(
                F.lit(label).alias("horizon"),
                F.lit(h).alias("trading_days"),
                F.lead("close", h).over(spec).alias("end_price"),
                F.lead("date", h).over(spec).alias("end_date"),
            )
            for label, h in horizons.items()
        ]
    )
    frame = bars.select(
        *keys,
        "date",
        "close",
        (F.row_number().over(spec) - 1).alias("i"),
        F.count(F.lit(1)).over(group).alias("n"),
        exits.alias("_exits"),
    )
    panel = frame.select(*keys, "date", "close", "i", "n", F.explode("_exits").alias("_e")).select(
        *keys, "date", "close", "i", "n", "_e.*"
    )
    return panel.withColumn("fwd", F.try_divide("end_price", "close") - 1)


def with_slice(bars: DataFrame) -> DataFrame:
    """Mark the oldest floor(0.85 n) rows of an instrument as train, the rest as test."""
    group = Window.partitionBy("ticker")
    row = F.row_number().over(group.orderBy("date")) - 1
    cut = F.floor(F.count(F.lit(1)).over(group) * F.lit(1 - config.TEST_FRACTION))
    return bars.select(
        "ticker", "date", "close", F.when(row < cut, F.lit("train")).otherwise(F.lit("test")).alias("slice")
    )


def hit_rates(bars: DataFrame, horizons: dict[str, int] = config.HORIZONS) -> DataFrame:
    """How often holding for h days paid, in each slice; windows never cross the split."""
    panel = forward_panel(with_slice(bars), horizons, "ticker", "slice")
    won = (F.col("fwd") > 0).cast("double")
    train, test = F.col("slice") == "train", F.col("slice") == "test"
    grouped = panel.groupBy("ticker", "horizon", "trading_days").agg(
        F.avg(F.when(train, won)).alias("train_hit_rate"),
        F.count(F.when(train, won)).alias("train_n"),
        F.avg(F.when(test, won)).alias("test_hit_rate"),
        F.count(F.when(test, won)).alias("test_n_windows"),
    )
    return grouped.withColumns(
        {
            "effective_independent_n": F.floor(F.col("test_n_windows") / F.col("trading_days")),
            "reliable": F.col("test_n_windows") >= config.MIN_TEST_WINDOWS,
        }
    )


def horizon_pivot(rates: DataFrame, horizons: list[str] = config.COMPARISON_HORIZONS) -> DataFrame:
    """One row per instrument: rate, reliability and independent n of the chosen horizons."""
    columns = []
    for label in horizons:
        here = F.col("horizon") == label
        columns += [
            F.max(F.when(here, F.col("test_hit_rate"))).alias(label),
            F.max(F.when(here, F.col("reliable"))).alias(f"{label} reliable"),
            F.max(F.when(here, F.col("effective_independent_n"))).alias(f"{label} independent_n"),
        ]
    return rates.where(F.col("horizon").isin(horizons)).groupBy("ticker").agg(*columns)


def shortest_reliable(rates: DataFrame, floor: float = config.RELIABLE_HIT_RATE) -> DataFrame:
    """The shortest horizon whose test hit rate reached ``floor`` on enough windows; NULL if none."""
    good = (F.col("test_hit_rate") >= floor) & F.col("reliable")
    row = F.struct(
        F.col("horizon").alias("horizon_label"),
        F.col("trading_days").alias("horizon_days"),
        F.col("test_hit_rate").alias("oos_hit_rate"),
        F.col("train_hit_rate"),
        F.col("test_n_windows"),
        F.col("effective_independent_n").alias("independent_n"),
    )
    best = F.min_by(row, F.when(good, F.col("trading_days"))).alias("_best")
    return rates.groupBy("ticker").agg(best).select("ticker", "_best.*")


def _outcome() -> list[Column]:
    return [
        (F.col("fwd") * 100).alias("return_pct"),
        F.lit("UP").alias("predicted"),
        (F.col("fwd") > 0).alias("correct"),
    ]


def non_overlapping_windows(bars: DataFrame, horizons: dict[str, int] = config.VERIFY_HORIZONS) -> DataFrame:
    """Independent instances of 'up over h days' inside the test slice: starts 0, h, 2h, ..."""
    panel = forward_panel(with_slice(bars).where(F.col("slice") == "test"), horizons, "ticker")
    return panel.where((F.col("i") % F.col("trading_days") == 0) & F.col("end_price").isNotNull()).select(
        "ticker",
        "horizon",
        F.col("date").alias("start_date"),
        "end_date",
        F.col("close").alias("start_price"),
        "end_price",
        *_outcome(),
    )


def verified_calls(windows: DataFrame) -> DataFrame:
    return windows.groupBy("ticker", "horizon").agg(
        F.count_if("correct").alias("n_correct"), F.count(F.lit(1)).alias("n_total")
    )


def recent_windows(bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """The newest completed window per horizon, or a note where history is too short."""
    panel = forward_panel(bars, horizons, "ticker")
    newest = F.col("i") == F.col("n") - 1 - F.col("trading_days")
    row = F.struct(
        F.col("date").alias("start_date"),
        "end_date",
        F.col("close").alias("start_price"),
        "end_price",
        *_outcome(),
    )
    return (
        panel.groupBy("ticker", "horizon")
        .agg(F.max(F.when(newest, row)).alias("_w"))
        .select(
            "ticker",
            "horizon",
            "_w.*",
            F.when(F.col("_w").isNull(), F.lit("not enough history")).alias("note"),
        )
    )


def _own_samples(panel: DataFrame, as_of: str) -> DataFrame:
    """Completed windows, weighted by the age of their start on day ``as_of``."""
    return panel.where(F.col("fwd").isNotNull()).select(
        "ticker",
        "horizon",
        F.col("fwd").alias("value"),
        weights.recency_by_days(F.col(as_of), F.col("date")).alias("weight"),
    )


def _market_medians(
    panel: DataFrame, market: DataFrame, horizons: dict[str, int], as_of: str, before_only: bool
) -> DataFrame:
    """The market's weighted median once per distinct (as-of day, horizon), not per instrument."""
    days = panel.select("horizon", F.col(as_of).alias("as_of")).where(F.col("as_of").isNotNull()).distinct()
    history = forward_panel(market.select("date", "close", F.lit(0).alias("_m")), horizons, "_m").where(
        F.col("fwd").isNotNull()
    )
    values = history.select("horizon", "date", "end_date", F.col("fwd").alias("value"))
    # Before an anchor only finished windows count; a live forecast weighs all of them by the age of their start.
    known = {"known": "end_date", "strictly": True} if before_only else {"known": "date", "strictly": False, "unknown_too": True}
    return prior.as_of_medians(days, values, "horizon", **known).withColumnRenamed("as_of", as_of)


def with_anchor(panel: DataFrame, days_ago: int = config.ANCHOR_DAYS_AGO) -> DataFrame:
    """Add the row number and day of the bar ``days_ago`` bars before the newest one."""
    at = F.col("n") - 1 - days_ago
    day = F.max(F.when(F.col("i") == at, F.col("date"))).over(Window.partitionBy("ticker", "horizon"))
    return panel.where(at >= config.ANCHOR_MIN_HISTORY).withColumns({"anchor_i": at, "anchor_date": day})


def expected_vs_actual(
    bars: DataFrame,
    market: DataFrame,
    horizons: dict[str, int] = config.FORECAST_HORIZONS,
    days_ago: int = config.ANCHOR_DAYS_AGO,
) -> DataFrame:
    """Estimates from history strictly before the anchor day against what then happened."""
    panel = with_anchor(forward_panel(bars, horizons, "ticker"), days_ago)
    before = panel.where(F.col("i") + F.col("trading_days") < F.col("anchor_i"))
    own = estimators.point_estimates(_own_samples(before, "anchor_date"), "ticker", "horizon")
    anchors = panel.where(F.col("i") == F.col("anchor_i")).select(
        "ticker",
        "horizon",
        "trading_days",
        "anchor_date",
        F.col("close").alias("anchor_price"),
        F.col("end_date").alias("target_date"),
        F.col("end_price").alias("target_price"),
        F.col("fwd").alias("actual"),
    )
    medians = _market_medians(anchors, market, horizons, "anchor_date", before_only=True)
    joined = anchors.join(own, ["ticker", "horizon"], "left").join(medians, ["horizon", "anchor_date"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    shrunk = estimators.shrink(
        F.col("recency_weighted_median"), F.col("market_median"), F.floor(n / F.col("trading_days"))
    )
    known = (n > 0) & F.col("actual").isNotNull()
    candidates = F.array(
        *[F.struct(F.lit(name).alias("estimator"), F.col(name).alias("expected")) for name in estimators.NAMES],
        F.struct(F.lit(config.LIVE_ESTIMATOR).alias("estimator"), shrunk.alias("expected")),
    )
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("estimator"), F.lit(None).cast("double").alias("expected")))
    rows = joined.withColumn("_n", n).withColumn("_c", F.explode(F.when(known, candidates).otherwise(nothing)))
    expected, actual, present = F.col("_c.expected"), F.col("actual"), F.col("_c.estimator").isNotNull()
    return rows.select(
        "ticker",
        "horizon",
        F.col("_c.estimator").alias("estimator"),
        "anchor_date",
        "anchor_price",
        (expected * 100).alias("expected_return_pct"),
        F.col("_n").alias("expected_n_samples"),
        F.when(present, F.col("target_date")).alias("target_date"),
        F.when(present, F.col("target_price")).alias("target_price"),
        F.when(present, actual * 100).alias("actual_return_pct"),
        ((actual - expected) * 100).alias("error_pct_points"),
        ((expected > 0) == (actual > 0)).alias("direction_match"),
    )


def estimator_league(checked: DataFrame) -> DataFrame:
    """MAE, direction match and n per estimator; the best one is rank 1."""
    league = (
        checked.where(F.col("direction_match").isNotNull())
        .groupBy("estimator")
        .agg(
            F.avg(F.abs("error_pct_points")).alias("mae_pct_points"),
            F.avg(F.col("direction_match").cast("double")).alias("direction_match_rate"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    # At most one row per estimator, so ranking them together is a handful of rows.
    return league.withColumn("rank", F.row_number().over(Window.orderBy("mae_pct_points", "estimator")))


def horizon_track_record(checked: DataFrame, estimator: str = config.LIVE_ESTIMATOR) -> DataFrame:
    rows = checked.where(
        (F.col("estimator") == estimator)
        & F.col("error_pct_points").isNotNull()
        & F.col("direction_match").isNotNull()
    )
    return rows.groupBy("horizon").agg(
        F.avg(F.abs("error_pct_points")).alias("mae_pts"),
        F.avg(F.col("direction_match").cast("double")).alias("direction_match_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def live_forecast(
    bars: DataFrame, market: DataFrame, horizons: dict[str, int] = config.FORECAST_HORIZONS
) -> DataFrame:
    """Forecast from the newest bar: shrunk estimate over all history plus the test-slice hit rate."""
    panel = forward_panel(bars, horizons, "ticker")
    newest = Window.partitionBy("ticker", "horizon")
    panel = panel.withColumn("as_of_date", F.max("date").over(newest))
    own = estimators.point_estimates(_own_samples(panel, "as_of_date"), "ticker", "horizon")
    heads = panel.where(F.col("date") == F.col("as_of_date")).select(
        "ticker", "horizon", "trading_days", "as_of_date", F.col("close").alias("last_price")
    )
    medians = _market_medians(heads, market, horizons, "as_of_date", before_only=False)
    names = F.create_map(*[F.lit(x) for pair in config.FORECAST_TO_HIT_RATE_LABEL.items() for x in pair])
    wanted = {k: v for k, v in config.HORIZONS.items() if k in config.FORECAST_TO_HIT_RATE_LABEL.values()}
    rates = hit_rates(bars, wanted).select(
        "ticker", F.col("horizon").alias("_rate_label"), "test_hit_rate", "reliable", "effective_independent_n"
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    estimate = estimators.shrink(
        F.col("recency_weighted_median"), F.col("market_median"), F.floor(n / F.col("trading_days"))
    )
    joined = (
        heads.join(own, ["ticker", "horizon"], "left")
        .join(medians, ["horizon", "as_of_date"], "left")
        .withColumn("_rate_label", names[F.col("horizon")])
        .join(rates, ["ticker", "_rate_label"], "left")
        .withColumn("_estimate", estimate)
    )
    return joined.select(
        "ticker",
        "horizon",
        "as_of_date",
        "last_price",
        (F.col("_estimate") * 100).alias("expected_return_pct"),
        labels.predicted_price(F.col("last_price"), F.col("_estimate")).alias("predicted_price"),
        dates.add_business_days(F.col("as_of_date"), F.col("trading_days")).alias("target_date"),
        n.alias("n_historical_samples"),
        F.col("test_hit_rate").alias("oos_hit_rate"),
        F.coalesce("reliable", F.lit(False)).alias("reliable"),
        F.coalesce("effective_independent_n", F.lit(0)).alias("effective_independent_n"),
    )


def long_horizon_calls(bars: DataFrame) -> DataFrame:
    """The call table: UP over the shortest reliable horizon, with its confidence, or no call."""
    best = shortest_reliable(hit_rates(bars))
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    called = F.col("horizon_label").isNotNull()
    target = dates.add_business_days(F.col("last_date"), F.col("horizon_days"))
    call = F.format_string("UP by ~%s (%s out)", target.cast("string"), F.col("horizon_label"))
    return best.join(last, "ticker").select(
        "ticker",
        F.when(called, call).otherwise(F.lit("no confident long-horizon call")).alias("call"),
        F.col("oos_hit_rate").alias("historical_out_of_sample_hit_rate"),
        F.when(called, labels.confidence_text(F.col("independent_n"))).otherwise(F.lit("n/a")).alias("confidence"),
        F.when(called, F.lit("")).otherwise(F.lit("no horizon reliably reached 80% out-of-sample")).alias("reason"),
    )
