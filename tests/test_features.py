import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import dates, windows
from quaymark.functions.smoothing import BLOCK, Smooth, number_rows, smooth
from quaymark.operators import asof, audit, features
from tests.helpers import bars, day, rows_by


def recursive(values, alpha):
    out = [values[0]]
    for v in values[1:]:
        out.append(out[-1] + alpha * (v - out[-1]))
    return out


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 27, 1 / 14, 2 / 10, 2 / 101])
def test_smoothing_equals_recursion_across_blocks(spark, alpha):
    values = (100 + np.random.default_rng(7).normal(size=4 * BLOCK + 17).cumsum()).tolist()
    frame = smooth(number_rows(bars(spark, {"A": values}), "ticker"), {"y": Smooth("close", alpha)}, "ticker")
    got = [r["y"] for r in frame.orderBy("date").collect()]
    assert np.allclose(got, recursive(values, alpha), rtol=1e-12, atol=0)


def test_flat_prices(spark):
    last = features.own_features(bars(spark, {"A": [10.0] * 60})).orderBy(F.desc("date")).first()
    assert last["rsi_14"] == 50 and last["bb_position"] is None and last["bb_width"] == 0
    assert last["ret_1d"] == 0 and last["macd"] == pytest.approx(0, abs=1e-12)


def test_all_gains_read_fifty(spark):
    frame = features.own_features(bars(spark, {"A": [float(i) for i in range(1, 40)]}))
    assert {r["rsi_14"] for r in frame.collect()} == {50.0}


def test_rsi_equals_recursion(spark):
    closes = (100 + np.random.default_rng(3).normal(size=80).cumsum()).tolist()
    got = [r["rsi_14"] for r in features.own_features(bars(spark, {"A": closes})).orderBy("date").collect()]
    moves = np.diff(closes)
    up, down = recursive(np.clip(moves, 0, None), 1 / 14), recursive(np.clip(-moves, 0, None), 1 / 14)
    want = [50.0] * 14 + [100 - 100 / (1 + u / d) for u, d in zip(up[13:], down[13:])]
    assert np.allclose(got, want)


def test_zero_volume_gives_no_change(spark):
    frame = features.own_features(bars(spark, {"A": [10.0, 11.0, 12.0]}, {"A": [0.0, 5.0, 10.0]}))
    assert [r["vol_change"] for r in frame.orderBy("date").collect()] == [None, None, 1.0]


def test_last_row_has_no_target(spark):
    last = features.own_features(bars(spark, {"A": [10.0, 11.0]})).orderBy(F.desc("date")).first()
    assert last["target_return"] is None and last["target_direction"] is None


def test_warm_up_needs_all_rows(spark):
    w = windows.calendar("ticker")
    frame = bars(spark, {"A": [1.0, 2.0, 3.0, 4.0]}).select("date", windows.rolling_mean(F.col("close"), 3, w).alias("m"))
    assert [r["m"] for r in frame.orderBy("date").collect()] == [None, None, 2.0, 3.0]


def test_one_exchange_by_ticker(spark):
    plan = features.own_features(bars(spark, {"A": [1.0, 2.0]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_asof_never_reads_later_days_and_carries_each_column(spark):
    rows = bars(spark, {"A": [1.0] * 6, "B": [1.0] * 6}).select("ticker", "date")
    values = spark.createDataFrame(
        [(day(1), 1.0, None), (day(3), None, 5.0), (day(10), 9.0, 9.0)], "date date, x double, y double"
    )
    got = rows_by(asof.align_shared(rows, values, ["x", "y"]), "ticker", "date")
    for t in "AB":
        assert [got[t, day(i)]["x"] for i in range(6)] == [None, 1.0, 1.0, 1.0, 1.0, 1.0]
        assert [got[t, day(i)]["y"] for i in range(6)] == [None, None, None, 5.0, 5.0, 5.0]


def test_weekend_values_show_on_monday_unless_monday_has_its_own(spark):
    friday, saturday, monday = dt.date(2020, 1, 3), dt.date(2020, 1, 4), dt.date(2020, 1, 6)
    rows = spark.createDataFrame([(t, d) for t in "AB" for d in (friday, monday)], "ticker string, date date")
    values = spark.createDataFrame(
        [("A", saturday, 1), ("B", saturday, 1), ("B", monday, 2)], "ticker string, date date, n int"
    )
    got = rows_by(asof.align_per_entity(rows, values, ["n"]), "ticker", "date")
    assert got["A", monday]["n"] == 1 and got["B", monday]["n"] == 2 and got["A", friday]["n"] is None


def test_ticker_before_macro_history_is_dropped(spark):
    frame = features.own_features(bars(spark, {"A": [float(i % 7 + 1) for i in range(80)]}))
    late = spark.createDataFrame([(day(500), *[1.0] * 25)], ["date", *schemas.MACRO_FEATURES])
    joined = asof.align_shared(frame, late.withColumn("date", F.col("date").cast("date")), schemas.MACRO_FEATURES)
    assert features.dataset(joined, schemas.FEATURE_SETS["with_macro"]).count() == 0
    assert joined.count() == 80


def test_business_days_equal_numpy(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(21)]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    for h in (1, 5, 6, 63, 252):
        got = {r["d"]: r["t"] for r in frame.select("d", dates.add_business_days(F.col("d"), h).alias("t")).collect()}
        for d in days:
            want = np.busday_offset(d, h, roll="backward")
            assert np.datetime64(got[d]) == want, (d, h)


def test_weekday_circle(spark):
    row = spark.sql("select date'2020-01-06' d").select(
        dates.weekday_sin(F.col("d")).alias("s"), dates.weekday_cos(F.date_add("d", 1)).alias("c")
    ).first()
    assert row["s"] == 0 and row["c"] == pytest.approx(math.cos(2 * math.pi / 5))


def test_audit_finds_a_planted_leak(spark):
    def leaky(frame, *more):
        return features.own_features(frame, *more).withColumn(
            "hl_range", F.max("close").over(windows.calendar("ticker", *more).rowsBetween(0, 5))
        )

    closes = (100 + np.random.default_rng(5).normal(size=220).cumsum()).tolist()
    table = bars(spark, {"A": closes})
    clean, planted = audit.audit_own(table).first(), audit.audit_own(table, leaky).first()
    assert clean["n_leaks"] == 0 and clean["n_cutoffs"] == 5 and clean["n_checked"] == 115
    hashed = audit.audit_own(bars(spark, {"Brand#12": closes})).first()  # a name is never cut apart
    assert (hashed["ticker"], hashed["n_leaks"]) == ("Brand#12", 0)
    assert planted["n_leaks"] > 0 and planted["leaking"] == "hl_range"


def test_value_against_null_is_a_leak(spark):
    frame = spark.createDataFrame([(1.0, None), (None, None), (1.0, 1.0 + 1e-12)], "f double, t double")
    got = [r["x"] for r in frame.select(audit.leaked(F.col("f"), F.col("t")).alias("x")).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize("alpha", [0.05, 0.6, 0.95, 1.0])
def test_smoothing_of_any_alpha(spark, alpha):
    values = [1000.0 + (i * 37) % 101 for i in range(700)]
    frame = smooth(number_rows(bars(spark, {"A": values}), "ticker"), {"y": Smooth("close", alpha)}, "ticker")
    want, level = [], values[0]
    for value in values:
        level = alpha * value + (1 - alpha) * level
        want.append(level)
    got = [r["y"] for r in frame.orderBy("_i").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6
