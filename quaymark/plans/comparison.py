"""Side-by-side descriptive reports per instrument. Statistics only, no advice."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark import config
from quaymark.operators import backtest, drift, metrics, splits
from quaymark.operators.features import complete_rows


def held_out(
    scored: DataFrame, targets: DataFrame, models: DataFrame | None = None, required: list[str] | None = None
) -> DataFrame:
    """RMSE, balanced accuracy and days of the shipped models on the newest 15% of complete rows.

    ``scored`` has pred_return and up_probability per day; ``targets`` the two targets per day.
    ``required`` also asks for these feature columns, so that all instruments are judged on rows
    with the full feature set, whichever set their models use.
    """
    usable = complete_rows(scored, required) if required else scored
    rows = usable.where("complete").join(targets, ["ticker", "date"])
    test = splits.share_split(rows, "ticker").where("split = 'test'")
    errors = metrics.regression_metrics(test, "ticker", prediction="pred_return").select(
        "ticker", F.col("rmse").alias("held_out_test_rmse")
    )
    called = test.withColumn("called_up", (F.col("up_probability") > config.UP_THRESHOLD).cast("int"))
    accuracy = metrics.classification_metrics(called, "ticker").select(
        "ticker", F.col("balanced_accuracy").alias("held_out_test_balanced_accuracy")
    )
    days = test.groupBy("ticker").agg(F.count(F.lit(1)).alias("held_out_test_days"))
    report = errors.join(accuracy, "ticker").join(days, "ticker")
    if models is None:
        return report

    def kind(task: str):
        return F.max(F.when(F.col("task") == task, F.col("model")))

    kinds = models.groupBy("ticker").agg(
        kind("regression").alias("regressor_type"), kind("classification").alias("classifier_type")
    )
    return report.join(kinds, "ticker", "left")


def long_horizon_columns(rates: DataFrame) -> DataFrame:
    best = drift.shortest_reliable(rates)
    called = F.col("horizon_label").isNotNull()
    return best.select(
        "ticker",
        F.when(called, F.concat(F.lit("UP over "), F.col("horizon_label")))
        .otherwise(F.lit("none reliable (see long-horizon drift)"))
        .alias("long_horizon_call"),
        F.col("oos_hit_rate").alias("long_horizon_oos_hit_rate"),
    )


def ticker_comparison(held: DataFrame, log: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per instrument: held-out quality, the recent backtest and the long-horizon call."""
    return held.join(backtest.recent_stats(log), "ticker", "left").join(long_horizon_columns(rates), "ticker", "left")


def model_headlines(comparison: DataFrame, checked: DataFrame) -> DataFrame:
    """Single-row headlines: mean accuracy, persistence winners, forecast match rate and error."""
    quality = comparison.agg(
        F.avg("held_out_test_balanced_accuracy").alias("mean_balanced_accuracy"),
        F.count_if(F.col("classifier_type").contains("persistence")).alias("n_persistence_classifiers"),
    )
    forecasts = checked.where(
        (F.col("estimator") == config.LIVE_ESTIMATOR) & F.col("direction_match").isNotNull()
    ).agg(
        F.avg(F.col("direction_match").cast("double")).alias("forecast_match_rate"),
        F.avg(F.abs("error_pct_points")).alias("forecast_mae_pts"),
    )
    # Two one-row tables side by side.
    return quality.withColumn("_k", F.lit(1)).join(forecasts.withColumn("_k", F.lit(1)), "_k").drop("_k")
