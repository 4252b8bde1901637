"""Walk-forward trade log, its summaries and drawdown."""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config
from quaymark.functions import labels, windows


def cost_of(ticker: Column, costs: dict[str, float] = config.TRANSACTION_COST_BPS) -> Column:
    """Cost in bps of an instrument; unknown instruments pay the default."""
    if not costs:
        return F.lit(float(config.DEFAULT_COST_BPS))
    known = F.create_map(*[F.lit(x) for name, bps in costs.items() for x in (name, float(bps))])
    return F.coalesce(known[ticker], F.lit(float(config.DEFAULT_COST_BPS)))


def prior_day(scored: DataFrame, aged: bool = False) -> DataFrame:
    """Each day with what was known the day before, instead of looking the rows up one by one."""
    spec = windows.calendar("ticker")
    known = F.struct("close", "pred_return", "up_probability", "complete")
    return scored.select(
        "ticker",
        "date",
        F.col("close").alias("actual_close"),
        F.lag(known, 1).over(spec).alias("prior"),
        F.row_number().over(spec).alias("_day_no"),
        *([F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc())).alias("_age")] if aged else []),
    )


def _log(days: DataFrame, note: Column, costs: dict[str, float]) -> DataFrame:
    prior_close = F.col("prior.close")
    predicted = labels.predicted_price(prior_close, F.col("prior.pred_return"))
    actual_return = F.try_divide("actual_close", prior_close) - 1
    called = labels.direction(F.col("prior.up_probability"))
    happened = labels.direction_of_return(actual_return)
    gross = F.when(called == "UP", actual_return).otherwise(-actual_return) * 10_000
    cost = cost_of(F.col("ticker"), costs)
    values = {
        "prior_close": prior_close,
        "predicted_close": predicted,
        "actual_close": F.col("actual_close"),
        "price_error": predicted - F.col("actual_close"),
        "price_error_pct": F.try_divide(predicted - F.col("actual_close"), F.col("actual_close")) * 100,
        "predicted_direction": called,
        "actual_direction": happened,
        "direction_correct": called == happened,
        "gross_return_bps": gross,
        "assumed_cost_bps": cost,
        "net_return_bps": gross - cost,
    }
    return days.withColumn("note", note).select(
        "ticker", "date", *[F.when(F.col("note").isNull(), v).alias(k) for k, v in values.items()], "note"
    )


def _note() -> Column:
    return (
        F.when(F.col("_day_no").isNull(), F.lit("no trading data for this date"))
        .when(F.col("_day_no") == 1, F.lit("no prior day available"))
        .when(~F.coalesce(F.col("prior.complete"), F.lit(False)), F.lit("feature row incomplete (NaN)"))
    )


def trade_log(
    scored: DataFrame, costs: dict[str, float] = config.TRANSACTION_COST_BPS, days: int | None = config.BACKTEST_DAYS
) -> DataFrame:
    """The newest ``days`` days of each instrument (None: all of them), predicted from the day before.

    ``scored`` has (ticker, date, close, pred_return, up_probability, complete) for every day.
    """
    predicted = prior_day(scored, aged=days is not None).where(F.col("_day_no") > 1)
    return _log(predicted if days is None else predicted.where(F.col("_age") <= days), _note(), costs)


def trade_log_for(
    scored: DataFrame, dates: list[dt.date], costs: dict[str, float] = config.TRANSACTION_COST_BPS
) -> DataFrame:
    """The same for requested dates; a date without a prediction says why."""
    known = prior_day(scored)
    row = F.struct("date", F.struct("actual_close", "prior", "_day_no").alias("v"))
    # Each instrument keeps its rows of the asked dates only, then every asked date is looked up.
    asked = known.groupBy("ticker").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("date").isin(dates), row))).alias("_found")
    )
    looked_up = asked.withColumn("date", F.explode(F.array(*[F.lit(d) for d in dates]))).select(
        "ticker", "date", F.col("_found")[F.col("date")].alias("_v")
    )
    return _log(looked_up.select("ticker", "date", "_v.*"), _note(), costs)


def log_summary(log: DataFrame) -> DataFrame:
    """Accuracy and P&L per instrument and overall (ticker NULL) in one pass."""
    correct = F.col("direction_correct").cast("double")
    net = F.col("net_return_bps")
    return (
        log.where(F.col("direction_correct").isNotNull())
        .rollup("ticker")
        .agg(
            F.avg(correct).alias("directional_accuracy"),
            F.count_if("direction_correct").alias("n_correct"),
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs("price_error_pct")).alias("mean_abs_price_error_pct"),
            F.avg("gross_return_bps").alias("avg_gross_bps"),
            F.avg(net).alias("avg_net_bps"),
            F.avg((net > 0).cast("double")).alias("share_profitable"),
            (F.sum(net) / 100).alias("cumulative_net_pct"),
        )
    )


def drawdown_path(log: DataFrame) -> DataFrame:
    """Running sum of net returns in percent, its running peak and the distance below it."""
    so_far = windows.calendar("ticker").rowsBetween(Window.unboundedPreceding, 0)
    curve = log.where(F.col("direction_correct").isNotNull()).select(
        "ticker", "date", (F.sum("net_return_bps").over(so_far) / 100).alias("cum_net_pct")
    )
    return curve.withColumn(
        "drawdown_pct", F.col("cum_net_pct") - F.max("cum_net_pct").over(so_far)
    )


def drawdown(log: DataFrame, stop_pct: float = config.MAX_DRAWDOWN_STOP_PCT) -> DataFrame:
    below = F.col("drawdown_pct")
    return drawdown_path(log).groupBy("ticker").agg(
        F.min(below).alias("max_drawdown_pct"),
        F.lit(-stop_pct).alias("stop_threshold_pct"),
        F.min(F.when(below <= -stop_pct, F.col("date"))).alias("would_have_stopped_on"),
    )


def recent_stats(log: DataFrame) -> DataFrame:
    """The comparison report's view of the log."""
    return (
        log.where(F.col("direction_correct").isNotNull())
        .groupBy("ticker")
        .agg(
            F.avg(F.col("direction_correct").cast("double")).alias("recent_accuracy"),
            F.avg("net_return_bps").alias("recent_net_bps_per_trade"),
            (F.sum("net_return_bps") / 100).alias("recent_cumulative_pct"),
        )
    )
