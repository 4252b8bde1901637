"""Nested dashboard document per instrument, assembled from the reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark import config


def _recent(log: DataFrame) -> DataFrame:
    correct = F.col("direction_correct")
    return log.where(correct.isNotNull()).groupBy("ticker").agg(
        F.avg(correct.cast("double")).alias("recent5d_accuracy"),
        F.count_if(correct).alias("recent5d_correct"),
        F.count(F.lit(1)).alias("recent5d_n"),
        F.avg("net_return_bps").alias("recent5d_avg_net_bps"),
        (F.sum("net_return_bps") / 100).alias("recent5d_cum_pct"),
    )


def _four_horizons(pivot: DataFrame) -> DataFrame:
    return pivot.select(
        "ticker", F.struct(*[F.col(f"`{h}`").alias(h) for h in config.COMPARISON_HORIZONS]).alias("four_horizon")
    )


def _checked_list(checked: DataFrame) -> DataFrame:
    days = F.create_map(*[F.lit(x) for pair in config.FORECAST_HORIZONS.items() for x in pair])
    row = F.struct(
        days[F.col("horizon")].alias("days"),
        F.col("horizon"),
        F.col("expected_return_pct").alias("expected_pct"),
        F.col("actual_return_pct").alias("actual_pct"),
        F.col("error_pct_points").alias("error_pts"),
        "direction_match",
        "target_date",
    )
    rows = checked.where(F.col("estimator") == config.LIVE_ESTIMATOR)
    # At most one row per forecast horizon and instrument.
    return rows.groupBy("ticker").agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("days")).alias("expected_vs_actual")
    )


def _forecast_map(forecast: DataFrame, checked: DataFrame) -> DataFrame:
    history = checked.where(F.col("estimator") == config.LIVE_ESTIMATOR).select(
        "ticker",
        "horizon",
        F.col("error_pct_points").alias("historical_error_pts"),
        F.col("direction_match").alias("historical_direction_correct"),
    )
    body = F.struct(
        "expected_return_pct", "predicted_price", "target_date", "oos_hit_rate", "reliable",
        "effective_independent_n", "n_historical_samples", "historical_error_pts", "historical_direction_correct",
    )
    return forecast.join(history, ["ticker", "horizon"], "left").groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", body.alias("v"))))).alias("horizon_forecast"),
        F.max("last_price").alias("last_price"),
    )


def _fundamentals(table: DataFrame) -> DataFrame:
    body: Column = F.struct(
        "trailing_pe", "forward_pe", F.col("market_cap_billions").alias("market_cap_b"), "price_to_book",
        "profit_margin_pct", "revenue_growth_pct", "sector",
    )
    return table.select("ticker", F.when(F.col("trailing_pe").isNotNull(), body).alias("fundamentals"))


def dashboard(
    comparison: DataFrame, log: DataFrame, pivot: DataFrame, checked: DataFrame, forecast: DataFrame, fundamentals: DataFrame
) -> DataFrame:
    """One nested row per instrument; every part is joined on the ticker after its own reduction."""
    head = comparison.select(
        "ticker",
        F.col("held_out_test_balanced_accuracy").alias("held_out_balanced_accuracy"),
        F.col("held_out_test_days").alias("held_out_days"),
        "classifier_type",
        "regressor_type",
        "long_horizon_call",
        F.col("long_horizon_oos_hit_rate").alias("long_horizon_hit_rate"),
    )
    parts = [
        _recent(log), _four_horizons(pivot), _checked_list(checked), _fundamentals(fundamentals),
        _forecast_map(forecast, checked),
    ]
    for part in parts:
        head = head.join(part, "ticker", "left")
    kinds = {name: head.schema[name].dataType for name in ("expected_vs_actual", "horizon_forecast")}
    no_rows = F.array().cast(kinds["expected_vs_actual"])
    forecast = kinds["horizon_forecast"]
    no_entries = F.map_from_arrays(
        F.array().cast(T.ArrayType(forecast.keyType)), F.array().cast(T.ArrayType(forecast.valueType))
    )
    return head.withColumns(
        {
            "expected_vs_actual": F.coalesce("expected_vs_actual", no_rows),
            "horizon_forecast": F.coalesce("horizon_forecast", no_entries),
        }
    )


def track_record_document(record: DataFrame) -> DataFrame:
    """The per-horizon track record as one nested row."""
    body = F.struct("mae_pts", "direction_match_rate", "n")
    return record.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", body.alias("v"))))).alias("horizon_track_record")
    )
