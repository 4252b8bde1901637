import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from quaymark.operators import news, pulse, sentiment
from quaymark.session import work_path
from quaymark.sources import articles, bars as bar_source, fundamentals, sinks
from tests.helpers import bars, day, rows_by


def test_keywords_null_and_missing_fields(spark):
    docs = [
        {"pub_date": "2020-01-02T05:00:00+0000", "headline": {"main": "H"}, "keywords": None},
        {"pub_date": "2020-01-03T05:00:00.000Z", "section_name": "Business", "news_desk": None, "abstract": "A",
         "headline": None, "keywords": [{"name": "organizations", "value": "Apple Inc"}, {"name": "subject", "value": "x"},
                                        {"name": "organizations", "value": "Nvidia"}, {"value": "nameless"}]},
    ]
    raw = spark.createDataFrame([(json.dumps({"response": {"docs": docs}}),)], "json string")
    slim = articles.slim_articles(raw).withColumn("date", articles.published_on(F.col("pub_date")))
    got = rows_by(slim, "date")
    assert got[dt.date(2020, 1, 2)]["organizations"] == "" and got[dt.date(2020, 1, 2)]["headline"] == "H"
    assert got[dt.date(2020, 1, 3)]["organizations"] == "Apple Inc; Nvidia"
    assert got[dt.date(2020, 1, 3)]["news_desk"] == "" and got[dt.date(2020, 1, 3)]["headline"] == ""


def flagged(spark):
    rows = [
        (1, "Food", "", "Baking an apple pie", "", ""),
        (2, "Business", "", "Apple ships", "", ""),
        (3, "World", "", "Trade", "", "NVIDIA Corp"),
        (4, "Sports", "Technology", "Game", "Microsoft wins", ""),
        (5, "Business", "", "", "", ""),
    ]
    schema = "id int, section_name string, news_desk string, headline string, abstract string, organizations string"
    return news.flag_articles(spark.createDataFrame(rows, schema))


def test_mentions_follow_tag_or_business_text(spark):
    got = rows_by(flagged(spark), "id")
    assert got[1]["tickers"] == [] and not got[1]["business_ctx"]
    assert got[2]["tickers"] == ["AAPL"] and got[3]["tickers"] == ["NVDA"] and got[4]["tickers"] == ["MSFT"]


def test_texts_are_lowered_once(spark):
    plan = flagged(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(concat(") == 1


def test_mentions_with_missing_fields(spark):
    rows = [(1, None, "", "Apple", "ships", "NVIDIA"), (2, "Business", None, None, "Apple", "nvidia"), (3, "Business", "", "Apple", "x", None)]
    schema = "id int, section_name string, news_desk string, headline string, abstract string, organizations string"
    got = rows_by(news.flag_articles(spark.createDataFrame(rows, schema)), "id")
    assert [got[k]["tickers"] for k in (1, 2, 3)] == [["NVDA"], ["NVDA"], ["AAPL"]]


def test_scorer_sees_only_gated_texts(spark):
    def load():
        def score(texts):
            assert all(t and t != "." and "pie" not in t for t in texts)
            return [float(len(t)) for t in texts]

        return score

    got = rows_by(news.score_articles(flagged(spark), news.text_scorer(load, batch=2)), "id")
    assert [got[i]["sentiment"] is None for i in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    assert got[2]["sentiment"] == len("Apple ships.")


def test_daily_news_counts_and_market_fallback(spark):
    scored = spark.createDataFrame(
        [(day(0), True, ["A"], 1.0), (day(0), True, [], None), (day(0), False, ["A"], 0.0), (day(1), False, ["A"], None)],
        "date date, business_ctx boolean, tickers array<string>, sentiment double",
    )
    daily = news.daily_news(scored)
    got = rows_by(daily, "scope", "date")
    assert got["market", day(0)]["n"] == 1 and got["A", day(0)]["sentiment_mean"] == 0.5
    assert got["A", day(1)]["n"] == 0 and got["A", day(1)]["sentiment_mean"] is None
    table = rows_by(news.ticker_news(daily, ["A", "INDEX"], ["A"]), "ticker", "date")
    assert table["INDEX", day(0)]["news_company_count"] == 1
    assert table["A", day(1)]["news_company_had_news"] == 0 and table["A", day(1)]["news_market_count"] == 0


def test_lexicon_scores(spark):
    lexicon = sentiment.lexicon_table(spark, {"good": 2.0, "bad": -2.5})
    texts = spark.createDataFrame([(1, "Good, GOOD; bad!"), (2, "plain"), (3, None)], "id int, text string")
    got = rows_by(sentiment.lexicon_sentiment(texts, lexicon, "id"), "id")
    assert got[1]["compound"] == 1.5 / (1.5**2 + 15) ** 0.5 and got[1]["n_hits"] == 3
    assert got[2]["compound"] == 0 and got[3]["compound"] is None


def test_pulse_tells_failed_from_quiet(spark):
    feeds = spark.createDataFrame(
        [("A", True, [("good", None), (None, "x")]), ("B", True, []), ("C", False, []), ("D", True, [(None, None)])],
        "symbol string, fetch_ok boolean, items array<struct<title:string,summary:string>>",
    )
    got = rows_by(pulse.market_pulse(feeds, sentiment.lexicon_table(spark, {"good": 2.0})), "symbol")
    assert got["A"]["had_news"] is True and got["A"]["n_headlines"] == 2 and got["A"]["label"] == "positive"
    assert got["B"]["had_news"] is False and got["B"]["label"] == "no recent news"
    assert got["C"]["had_news"] is None and got["C"]["label"] == "unavailable (fetch failed)"
    assert got["D"]["n_headlines"] == 1 and got["D"]["label"] == "neutral"
    assert pulse.ordered_symbols(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_feeds_keep_the_first_items_of_a_hot_symbol(spark):
    items = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('s', id)) symbol", "id position", "cast(id as string) title", "'' summary"
    )
    feeds = pulse.feeds_from_items(items, limit=10)
    assert pulse.feeds_from_items(items).where("symbol = 'hot'").first()["items"][10]["title"] == "30"
    hot = feeds.where("symbol = 'hot'").first()
    assert [i["title"] for i in hot["items"]] == [str(3 * k) for k in range(10)]
    assert "WindowGroupLimit" in feeds._jdf.queryExecution().executedPlan().toString()


def test_bars_of_a_hot_ticker_equal_pandas(spark):
    ticks = spark.range(9000).selectExpr(
        "id", "if(id % 3 = 0, 'HOT', concat('T', id % 50)) ticker", "date_add(date'2020-01-01', cast(id % 7 as int)) date",
        "cast((id * 7919) % 1009 as double) price",
    )
    got = bar_source.bars_from_ticks(ticks, "price", F.col("id"), "ticker", "date").toPandas()
    flat = ticks.toPandas().sort_values("id").groupby(["ticker", "date"])["price"]
    want = flat.agg(open="first", high="max", low="min", close="last", volume="size").reset_index()
    merged = got.merge(want, on=["ticker", "date"], suffixes=("", "_w"))
    assert len(merged) == len(got) == len(want)
    for c in ("open", "high", "low", "close", "volume"):
        assert (merged[c] == merged[f"{c}_w"]).all()


def test_outage_guard_choices(spark):
    current = bars(spark, {"A": [1.0] * 30, "B": [1.0] * 30, "C": [1.0] * 20, "GONE": [1.0] * 5})
    incoming = bars(spark, {"A": [2.0] * 14, "B": [2.0] * 15, "C": [2.0], "NEW": [2.0]})
    got = {
        r["ticker"]: (r["n"], r["c"])
        for r in bar_source.guard_outage(current, incoming)
        .groupBy("ticker")
        .agg(F.count("*").alias("n"), F.max("close").alias("c"))
        .collect()
    }
    assert got == {"A": (30, 1.0), "B": (15, 2.0), "C": (1, 2.0), "GONE": (5, 1.0), "NEW": (1, 2.0)}


def test_upsert_keeps_what_the_guard_refuses(spark):
    path = work_path(spark, "bars")
    bar_source.upsert_bars(spark, path, bars(spark, {"A": [1.0] * 30, "B": [1.0] * 30}))
    bar_source.upsert_bars(spark, path, bars(spark, {"A": [2.0] * 3, "B": [2.0] * 31}))
    stored = spark.read.parquet(path).groupBy("ticker").agg(F.count("*").alias("n"), F.max("close").alias("c"))
    assert {r["ticker"]: (r["n"], r["c"]) for r in stored.collect()} == {"A": (30, 1.0), "B": (31, 2.0)}


def test_unsettled_bars_and_csv(spark, tmp_path):
    path = str(tmp_path / "bars.csv")
    pd.DataFrame(
        {"ticker": ["A", "A"], "date": ["2020-01-01", "2020-01-02"], "open": [1, 2], "high": [1, 2], "low": [1, 2],
         "close": [1.5, None], "volume": [3, 4]}
    ).to_csv(path, index=False)
    assert [r["close"] for r in bar_source.read_bars(spark, path).collect()] == [1.5]
    nan = spark.createDataFrame([("A", float("nan"))], "ticker string, close double")
    assert bar_source.settled(nan).count() == 0


def test_month_store_rescores_only_the_open_month(spark):
    path = work_path(spark, "scored")
    rows = articles.with_month(
        spark.createDataFrame([(1, dt.date(2020, 1, 5)), (2, dt.date(2020, 2, 5))], "id int, date date")
    )
    seen = []

    def score(version):
        def run(frame):
            seen.append(sorted(r["id"] for r in frame.collect()))
            return frame.withColumn("sentiment", F.lit(version))

        return run

    today = dt.date(2020, 2, 20)
    articles.refresh_scored(spark, rows, path, today, score(1.0))
    later = rows.unionByName(articles.with_month(spark.createDataFrame([(3, dt.date(2020, 2, 9))], "id int, date date")))
    store = articles.refresh_scored(spark, later, path, today, score(2.0))
    assert seen == [[1, 2], [2, 3]]
    assert {r["id"]: r["sentiment"] for r in store.collect()} == {1: 1.0, 2: 2.0, 3: 2.0}
    pruned = articles.month_range(store, "2020-02", "2020-02")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
    assert articles.recent_months(store, dt.date(2020, 3, 3)).count() == 2


def test_fundamentals_falsy_values(spark):
    rows = [
        ("^IDX", {"marketCap": "0", "dividendYield": "0"}),
        ("X", {"marketCap": "2e9", "profitMargins": "0.1", "sector": "Tech", "dividendYield": "1.5"}),
        ("Y", {"sector": ""}),
    ]
    got = rows_by(fundamentals.flatten_fundamentals(spark.createDataFrame(rows, "symbol string, info map<string,string>")), "symbol")
    assert got["^IDX"]["sector"] == "Index, not a company" and got["^IDX"]["market_cap_billions"] is None
    assert got["X"]["market_cap_billions"] == 2 and got["X"]["profit_margin_pct"] == 10 and got["X"]["sector"] == "Tech"
    assert got["Y"]["sector"] is None


def test_report_sinks(spark):
    frame = spark.createDataFrame([("A", None, 1.0)], "ticker string, note string, x double")
    for fmt in ("csv", "parquet", "json"):
        path = work_path(spark, f"report-{fmt}")
        sinks.write_report(frame, path, fmt)
        back = spark.read.option("header", "true").format(fmt).load(path)
        assert sorted(back.columns) == ["note", "ticker", "x"] and back.count() == 1
    assert json.loads(sinks.as_json(frame, "ticker").first()["document"]) == {"note": None, "x": 1.0}


def test_tick_bars_hash_and_lexicon_scores_shuffle_texts_only(spark):
    ticks = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 2, 10, 0), k, float(v)) for k, v in ((3, 7), (-9, 5), (2**62, 9))],
        "ticker string, ts timestamp, event_id long, value double",
    )
    made = bar_source.session_bars(ticks, "value", "event_id")
    row = made.first()
    assert (row["open"], row["close"]) == (5.0, 9.0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    texts = spark.createDataFrame([(1, "good good bad"), (2, None)], "id long, text string")
    scored = sentiment.lexicon_sentiment(texts, sentiment.lexicon_table(spark, {"good": 2.0, "bad": -1.0}), "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(word" not in plan
