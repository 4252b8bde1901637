import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark import config
from quaymark.functions import labels, weights
from quaymark.operators import backtest, baselines, drift, estimators, intraday, metrics, options, selection, splits
from tests.helpers import bars, day, rows_by


def test_chrono_split_has_a_floor_of_thirty(spark):
    table = bars(spark, {"A": [1.0] * 100, "B": [1.0] * 400})
    counts = splits.chrono_split(table, "ticker").groupBy("ticker", "split").count()
    assert {(r["ticker"], r["split"]): r["count"] for r in counts.collect()} == {
        ("A", "train"): 70, ("A", "test"): 30, ("B", "train"): 340, ("B", "test"): 60,
    }


def test_train_rows_come_before_test_rows(spark):
    table = bars(spark, {"A": [1.0] * 103})
    for frame, key in ((splits.chrono_split(table, "ticker"), "split"), (splits.share_split(table, "ticker"), "split")):
        span = {r[key]: (r["a"], r["b"]) for r in frame.groupBy(key).agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
        assert span["train"][1] < span["test"][0]


def test_expanding_folds_equal_time_series_split(spark):
    n, k = 103, 4
    folds = splits.expanding_folds(bars(spark, {"A": [1.0] * n}), "ticker", folds=k)
    got = folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("a")).collect()
    size = n // (k + 1)
    for r in got:
        start = n - (k - r["fold"]) * size
        assert (r["n"], r["a"]) == ((size, day(start)) if r["role"] == "test" else (start, day(0)))
    assert splits.expanding_folds(bars(spark, {"A": [1.0] * 49}), "ticker").count() == 0


def test_weights(spark):
    table = bars(spark, {"A": [1.0] * 505}).withColumn("y", (F.dayofmonth("date") == 1).cast("int"))
    frame = table.select("date", "y", weights.recency_by_rows("ticker").alias("w"), weights.balanced_class("y", "ticker").alias("b"))
    rows = frame.orderBy("date").collect()
    assert rows[-1]["w"] == 1 and rows[0]["w"] == 0.5
    assert sum(r["b"] for r in rows if r["y"] == 1) == pytest.approx(sum(r["b"] for r in rows if r["y"] == 0))


def test_metrics_with_one_class_only(spark):
    rows = spark.createDataFrame([("A", 1, 0), ("A", 0, 0)], "ticker string, called_up int, target_direction int")
    got = metrics.classification_metrics(rows, "ticker").first()
    assert got["balanced_accuracy"] == 0.5 and got["precision"] == 0 and got["recall"] == 0 and got["f1"] == 0
    signs = spark.createDataFrame([("A", 0.0, 0.0), ("A", 1.0, -1.0)], "ticker string, prediction double, target_return double")
    assert metrics.regression_metrics(signs, "ticker").first()["directional_accuracy"] == 0.5


def test_selection_is_pessimistic_and_skips_floors(spark):
    rows = [
        ("A", "classification", "baseline_majority", 0, 0.9, None, None),
        ("A", "classification", "lucky", 1, 0.7, 0.56, 0.2),
        ("A", "classification", "steady", 2, 0.5, 0.54, 0.01),
        ("A", "regression", "tie_first", 1, 0.2, 0.1, 0.0),
        ("A", "regression", "tie_second", 2, 0.1, 0.1, 0.0),
        ("B", "regression", "baseline_zero_return", 0, 0.1, None, None),
        ("B", "regression", "only_holdout", 1, 0.3, None, None),
    ]
    frame = spark.createDataFrame(
        rows, "ticker string, task string, model string, ordinal int, metric double, fold_mean double, fold_std double"
    )
    got = rows_by(selection.select_models(frame, "ticker"), "ticker", "task")
    assert got["A", "classification"]["model"] == "steady" and got["A", "regression"]["model"] == "tie_first"
    assert got["B", "regression"]["model"] == "only_holdout"
    assert got["B", "regression"]["selection_basis"] == "single_holdout_fallback"


def scored(spark, closes, calls):
    rows = [("A", day(i), c, 0.0, p, p is not None) for i, (c, p) in enumerate(zip(closes, calls))]
    return spark.createDataFrame(
        rows, "ticker string, date date, close double, pred_return double, up_probability double, complete boolean"
    )


def test_drawdown_starts_at_the_first_value(spark):
    log = backtest.trade_log(scored(spark, [100.0, 90.0, 91.0], [0.9, 0.9, 0.9]), {"A": 0})
    path = [r["drawdown_pct"] for r in backtest.drawdown_path(log).orderBy("date").collect()]
    assert path[0] == 0 and path[1] == 0
    assert backtest.drawdown(log).first()["would_have_stopped_on"] is None


def test_breach_exactly_at_the_threshold(spark):
    rows = [("A", day(i), True, bps) for i, bps in enumerate([100.0, -800.0, 500.0])]
    log = spark.createDataFrame(rows, "ticker string, date date, direction_correct boolean, net_return_bps double")
    got = backtest.drawdown(log).first()
    assert got["max_drawdown_pct"] == -8 and got["would_have_stopped_on"] == day(1)


def test_trade_log_reads_the_day_before(spark):
    log = backtest.trade_log(scored(spark, [100.0, 110.0, 99.0], [0.9, 0.53, 0.1]), {}).orderBy("date").collect()
    assert len(log) == 2 and log[0]["direction_correct"] and log[0]["gross_return_bps"] == pytest.approx(1000)
    assert log[1]["predicted_direction"] == "UP" and log[1]["net_return_bps"] == pytest.approx(-1005)


def test_notes(spark):
    asked = [day(0), day(1), day(2), dt.date(1999, 1, 1)]
    log = rows_by(backtest.trade_log_for(scored(spark, [1.0, 2.0, 3.0], [0.9, None, 0.9]), asked, {}), "date")
    assert log[day(0)]["note"] == "no prior day available" and log[day(1)]["note"] is None
    assert log[day(2)]["note"] == "feature row incomplete (NaN)" and log[day(2)]["prior_close"] is None
    assert log[dt.date(1999, 1, 1)]["note"] == "no trading data for this date"


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(0.52,), (0.5200001,)], "p double").select(labels.direction(F.col("p")).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["DOWN", "UP"]


def sample(spark, values, weight=1.0):
    return spark.createDataFrame([("A", float(v), weight) for v in values], "ticker string, value double, weight double")


@pytest.mark.parametrize("n", [1, 9, 10, 11, 40])
def test_point_estimates_equal_numpy(spark, n):
    values = np.random.default_rng(n).normal(size=n) ** 3
    got = estimators.point_estimates(sample(spark, values), "ticker").first()
    ordered = np.sort(values)
    q1, q3 = np.quantile(values, [0.25, 0.75])
    clipped = np.clip(values, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    trimmed = ordered[int(n * 0.1) : int(n * 0.9)].mean() if n >= 10 else values.mean()
    want = [values.mean(), np.median(values), trimmed, clipped.mean(), ordered[(n - 1) // 2]]
    assert np.allclose([got[c] for c in estimators.NAMES], want)


def test_weighted_median_leans_to_heavy_values(spark):
    rows = spark.createDataFrame([("A", 1.0, 0.1), ("A", 2.0, 0.2), ("A", 3.0, 0.9)], "ticker string, value double, weight double")
    assert estimators.weighted_median(rows, "ticker").first()["weighted_median"] == 3


def test_shrinkage(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 20), (1.0, None, 5), (None, 3.0, 0)], "o double, m double, n int")
    got = [r["s"] for r in rows.select(estimators.shrink(F.col("o"), F.col("m"), F.col("n")).alias("s")).collect()]
    assert got == [2.0, 1.0, None]


def test_window_needs_one_more_bar_than_the_horizon(spark):
    got = rows_by(drift.recent_windows(bars(spark, {"A": [1.0] * 5, "B": [1.0] * 4 + [2.0, 3.0]}), {"h": 5}), "ticker")
    assert got["A"]["note"] == "not enough history" and got["A"]["correct"] is None
    assert got["B"]["return_pct"] == 200 and got["B"]["note"] is None


def test_windows_do_not_overlap_or_leave_the_test_slice(spark):
    closes = [float(i % 13 + 1) for i in range(1000)]
    rows = drift.non_overlapping_windows(bars(spark, {"A": closes}), {"m": 21}).orderBy("start_date").collect()
    assert len(rows) == 7 and rows[0]["start_date"] == day(850)
    assert all(a["end_date"] <= b["start_date"] for a, b in zip(rows, rows[1:]))


def test_hit_rates_never_cross_the_split(spark):
    got = drift.hit_rates(bars(spark, {"A": [float(i) for i in range(1, 101)]}), {"w": 5, "long": 50}).collect()
    by = {r["horizon"]: r for r in got}
    assert (by["w"]["train_n"], by["w"]["test_n_windows"], by["w"]["effective_independent_n"]) == (80, 10, 2)
    assert by["long"]["test_hit_rate"] is None and by["long"]["test_n_windows"] == 0 and not by["long"]["reliable"]


def test_expected_return_uses_only_earlier_history(spark):
    closes = [float(i % 17 + 5) for i in range(700)]
    base = bars(spark, {"A": closes})
    changed = bars(spark, {"A": closes[:448] + [c * 9 for c in closes[448:]]})
    horizons = {"3 months": 63}
    columns = ["estimator", "expected_return_pct"]
    first = rows_by(drift.expected_vs_actual(base, base, horizons).select(columns), "estimator")
    second = rows_by(drift.expected_vs_actual(changed, changed, horizons).select(columns), "estimator")
    assert first == second and len(first) == 6
    assert drift.expected_vs_actual(bars(spark, {"A": closes[:312]}), base, horizons).count() == 0


def session(spark, closes, start="2020-01-02 09:30:00"):
    first = dt.datetime.fromisoformat(start)
    rows = [("A", first + dt.timedelta(hours=i), c, c, c, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(
        rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
    )


def test_session_of_two_and_three_bars(spark):
    daily = bars(spark, {"A": [10.0 + i % 3 for i in range(30)]}).withColumn("date", F.date_sub("date", 26))
    assert intraday.snapshots(session(spark, [10.0, 11.0]), daily).count() == 0
    rows = intraday.snapshots(session(spark, [10.0, 11.0, 12.0]), daily).collect()
    assert len(rows) == 1 and rows[0]["pos_in_range"] == 1 and rows[0]["minutes_until_close"] == 330
    flat = intraday.snapshots(session(spark, [10.0, 10.0, 10.0]), daily).first()
    assert flat["pos_in_range"] == 0.5 and flat["target_return_to_close"] == 0
    assert intraday.live_snapshots(session(spark, [10.0]), daily).count() == 0


def test_time_buckets_are_right_closed(spark):
    rows = spark.createDataFrame([(0.0,), (60.0,), (61.0,), (390.0,), (391.0,)], "m double")
    got = [r["b"] for r in rows.select(intraday.time_bucket(F.col("m")).alias("b")).collect()]
    assert got == [None, "<1h to close", "1-2h", ">5h to close", None]


def test_options_nearest_and_missing_side(spark):
    today, near, far = dt.date(2020, 1, 1), dt.date(2020, 1, 29), dt.date(2020, 6, 1)
    rows = [
        ("X", near, "call", 100.0, 0.2, 101.0), ("X", near, "call", 111.0, 0.3, 101.0), ("X", near, "put", 100.0, 0.4, 101.0),
        ("X", near, "put", 91.0, 0.6, 101.0), ("X", near, "call", 101.0, 9.0, 101.0), ("X", far, "call", 101.0, 0.9, 101.0),
        ("Y", near, "call", 10.0, 0.2, 10.0),
    ]
    chain = spark.createDataFrame(rows, "symbol string, expiration date, side string, strike double, iv double, spot double")
    got = rows_by(options.with_unlisted(options.implied_vol(chain, today), ["X", "Y", "Z"]), "symbol")
    assert got["X"]["atm_iv"] == pytest.approx(0.3) and got["X"]["iv_skew"] == pytest.approx(0.3)
    assert got["Y"]["status"] == "no valid quotes" and got["Z"]["status"] == "unavailable"


def test_majority_class(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 1), ("A", 0), ("B", 0), ("B", 1)], "ticker string, target_direction int")
    assert {r["ticker"]: r["majority"] for r in baselines.majority_class(rows, "ticker").collect()} == {"A": 1, "B": 0}


def test_constants_are_consistent():
    assert set(config.FORECAST_TO_HIT_RATE_LABEL.values()) <= set(config.HORIZONS)
    assert set(config.COMPARISON_HORIZONS) <= set(config.HORIZONS)
