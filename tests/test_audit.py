"""Audits over segments against audits that copy the history once for every cut day."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.operators import asof, audit, macro, news
from quaymark.session import settle


def day(i):
    return datetime.date(2018, 12, 1) + datetime.timedelta(int(i))


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(t, day(i), 1.0 + i % 7, 2.0, 0.5, 1.0 + i % 5, 1.0) for t, n in (("A", 700), ("B", 350), ("C#1", 90)) for i in range(n)]
    return settle(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double"))


@pytest.fixture(scope="module")
def series(spark):
    """Dense and sparse series; one ends early, one starts late."""
    rng, rows = np.random.default_rng(7), []
    names = sorted({s for s, _ in macro.SERIES_FEATURES.values()} | {s for a, b, _ in macro.SPREADS.values() for s in (a, b)})
    for k, name in enumerate(names):
        first, last = (0, 150) if k == 1 else (400, 720) if k == 2 else (0, 720)
        for i in range(first, last):
            if rng.random() < (0.9, 0.3, 0.1)[k % 3]:
                rows.append((name, day(i), 100.0 + float(rng.normal())))
    return settle(spark.createDataFrame(rows, "series string, date date, close double"))


def by_copies(rows, days, features, columns, *keys):
    """What every prefix shows at its end, from one copy of the rows for each day."""
    known = rows.join(days, rows["date"] <= days["day"])
    return audit._last_known(features(known), columns, *keys, "day")


def same(a, b, keys):
    left, right = ({tuple(r[k] for k in keys): r for r in f.select(*b.columns).collect()} for f in (a, b))
    # a group without anything yet has a row of nulls or none
    for key in set(left) | set(right):
        x, y = left.get(key), right.get(key)
        for c in set(b.columns) - set(keys):
            u, v = (None if r is None else r[c] for r in (x, y))
            assert u == (None if v is None else pytest.approx(v, abs=1e-9)), (key, c)


def test_macro_segments_equal_copies(bars, series):
    days = settle(audit.cut_days(bars).select("day").distinct())
    known, spans = audit.segments(series, days, "series", memory=macro.Z_ROWS + 1)
    got = audit._as_of_cuts(macro.macro_features(known, "segment"), spans, days, schemas.MACRO_FEATURES)
    want = by_copies(series, days, lambda k: macro.macro_features(k, "day"), schemas.MACRO_FEATURES)
    same(got, want, ["day"])


def test_rows_stay_linear(series, spark):
    """Ten times the cut days bring only their carried rows."""
    for n in (5, 50):
        days = spark.createDataFrame([(day(i * 700 // n),) for i in range(1, n + 1)], "day date")
        known, _ = audit.segments(series, days, "series", memory=10)
        inside = series.where(F.col("date") <= day(700)).count()
        assert known.count() <= inside + n * 10 * series.select("series").distinct().count()


def test_reports_find_planted_leaks(bars, series):
    clean = audit.audit_macro(bars, series).collect()
    assert {r["ticker"] for r in clean} == {"A", "B", "C#1"} and all(r["n_leaks"] == 0 for r in clean)

    def leaky(rows, *by):
        ahead = Window.partitionBy(*by).orderBy("date") if by else Window.orderBy("date")
        table = macro.macro_features(rows, *by)
        return table.withColumn("vix_level", F.coalesce(F.lead("vix_level", 1).over(ahead), "vix_level"))

    found = {r["ticker"]: r["leaking"] for r in audit.audit_macro(bars, series, leaky).collect()}
    assert set(found.values()) == {"vix_level"}


def articles(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(900):
        when = day(rng.integers(0, 700))
        rows.append((when, float(rng.normal()) if i % 3 else None, bool(i % 2), ["A"] if i % 5 == 0 and i > 200 else []))
    return spark.createDataFrame(rows, "date date, sentiment double, business_ctx boolean, tickers array<string>")


def test_news_segments_equal_copies(spark, bars):
    rows, tickers = settle(articles(spark)), ["A", "B", "C#1"]
    days = settle(audit.cut_days(bars).select("day").distinct())
    known, spans = audit.segments(rows, days)
    rebuilt = news.ticker_news(news.daily_news(known, "segment"), tickers, ["A"], by=("segment",))
    got = audit._as_of_cuts(rebuilt, spans, days, schemas.NEWS_FEATURES, "ticker")
    want = by_copies(
        rows, days, lambda k: news.ticker_news(news.daily_news(k, "day"), tickers, ["A"], by=("day",)), schemas.NEWS_FEATURES, "ticker"
    )
    same(got, want, ["ticker", "day"])
    assert all(r["n_leaks"] == 0 for r in audit.audit_news(bars, rows, tickers, ["A"]).collect())

    def leaky(daily, tickers, covered, by=()):
        table = news.ticker_news(daily, tickers, covered, by)
        ahead = Window.partitionBy(*by, "ticker").orderBy("date")
        return table.withColumn("news_market_count", F.coalesce(F.lead("news_market_count").over(ahead), "news_market_count"))

    found = audit.audit_news(bars, rows, tickers, ["A"], leaky).collect()
    assert {r["leaking"] for r in found} == {"news_market_count"}


def test_nothing_to_cut(spark, bars, series):
    short = bars.where("ticker = 'none'")
    assert audit.audit_macro(short, series).collect() == []
    assert asof.align_shared(short, macro.macro_features(series), ["vix_level"]).count() == 0
