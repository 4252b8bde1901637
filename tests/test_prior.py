"""As-of weighted medians by descent against one sample for each day."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark import config
from quaymark.functions import weights
from quaymark.operators import drift, estimators, prior
from quaymark.session import settle


def day(i):
    return datetime.date(2010, 1, 1) + datetime.timedelta(int(i))


@pytest.fixture(scope="module")
def tables(spark):
    rng, rows = np.random.default_rng(4), []
    for horizon, n in (("6mo", 400), ("1yr", 37), ("2yr", 1)):
        at = np.sort(rng.choice(np.arange(3_000), n, replace=False))
        rows += [(horizon, day(i), day(i + 120 + int(rng.integers(0, 5))), float(np.round(rng.normal(), 1))) for i in at]
    history = spark.createDataFrame(rows, "horizon string, date date, end_date date, value double")
    asked = [(h, day(i)) for h in ("6mo", "1yr", "2yr", "none") for i in [-5, 0, *rng.integers(0, 3_300, 60).tolist()]]
    asked += [(r[0], r[2]) for r in rows[::17]] + [(r[0], r[1]) for r in rows[::13]]
    days = spark.createDataFrame(sorted(set(asked)), "horizon string, as_of date")
    return settle(history), settle(days)


@pytest.mark.parametrize("before_only", [True, False])
def test_descent_equals_pairs(tables, before_only):
    history, days = tables
    met = (history["end_date"] < days["as_of"]) if before_only else F.lit(True)
    pairs = days.join(history, (days["horizon"] == history["horizon"]) & met).select(
        days["horizon"], "as_of", "value", weights.recency_by_days(F.col("as_of"), F.col("date")).alias("weight")
    )
    want = {(r[0], r[1]): r[2] for r in estimators.weighted_median(pairs, "horizon", "as_of").collect()}
    how = {"known": "end_date", "strictly": True} if before_only else {"known": "date", "strictly": False, "unknown_too": True}
    got = {(r[0], r[1]): r[2] for r in prior.as_of_medians(days, history, "horizon", **how).collect()}
    assert got == want and len(want) > 100


def test_a_day_descends_over_about_root_n_rows(tables):
    history, _ = tables
    index = prior.indexed(history.where("horizon = '6mo'"), "horizon", known="end_date")
    facts = index.agg(F.max("width"), F.max("bucket"), F.max("block")).first()
    assert facts[0] == 20 and facts[1] <= 19 and facts[2] <= 19
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 20
    assert prior.grid(index, "horizon").count() == 21 * 20


def test_no_history(spark, tables):
    history, days = tables
    assert prior.as_of_medians(days, history.where("false"), "horizon", known="date", strictly=True).collect() == []


def test_reports_join_by_equality_only(spark):
    rows = [("A", day(i), 100.0 + i % 11) for i in range(300)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    market = bars.select(F.lit("MARKET").alias("ticker"), "date", "close")
    heads = drift.forward_panel(bars, config.FORECAST_HORIZONS, "ticker").withColumn("d", F.col("date"))
    medians = drift._market_medians(heads, market, config.FORECAST_HORIZONS, "d", before_only=True)
    plan = medians._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("=" in j for j in joins) and not any("end_date" in j for j in joins)
