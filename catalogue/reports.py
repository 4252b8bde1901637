"""Prediction rows, comparison reports and the dashboard document."""

import datetime as dt

from pyspark.sql import functions as F

from catalogue import drift as drift_queries
from catalogue.common import EVENT_DAYS, INTRADAY, emit, portable, query
from catalogue.context import FUND
from catalogue.evaluation import COSTS, DAYS, RECENT, ROWS, SUMMARY
from catalogue.bars import RET1
from catalogue.common import BARS
from catalogue.intraday import CONTEXT, RUNNING, SNAPS
from catalogue.models import persistence_models
from quaymark import config, schemas
from quaymark.functions import windows
from quaymark.operators import backtest, drift
from quaymark.plans import comparison, dashboard, predict, training
from quaymark.session import settle
from quaymark.sources import derived, fundamentals, sinks


def scored_table(spark, folder):
    """Daily returns of the segments scored by models from the store."""
    spec = windows.calendar("ticker")
    bars = settle(derived.daily_bars(spark, folder)).select("ticker", "date", "close")
    frame = bars.withColumn("ret_1d", windows.change(F.col("close"), 1, spec))
    frame = frame.withColumn("target_return", F.lead("ret_1d", 1).over(spec)).withColumn(
        "target_direction", (F.col("target_return") > 0).cast("int")
    )
    return training.score_shipped(frame, persistence_models(spark, folder))


def shipped_backtest(spark, folder):
    return portable(backtest.log_summary(backtest.trade_log(scored_table(spark, folder), COSTS)))


def _held_out(spark, folder, table):
    targets = table.where(F.col("target_return").isNotNull()).select("ticker", "date", "target_return", "target_direction")
    scored = table.select("ticker", "date", "pred_return", "up_probability", "complete")
    return comparison.held_out(scored, targets, persistence_models(spark, folder))


def held_out_test(spark, folder):
    return portable(_held_out(spark, folder, settle(scored_table(spark, folder))))


def next_day_predictions(spark, folder):
    """With one instrument lacking live context."""
    pulse = spark.createDataFrame(
        [("AUTOMOBILE", "positive"), ("BUILDING", "no recent news"), ("MACHINERY", "unavailable (fetch failed)")],
        "ticker string, label string",
    )
    vol = spark.createDataFrame([("AUTOMOBILE", 0.25, 0.04)], "ticker string, atm_iv double, iv_skew double")
    return portable(predict.next_day(scored_table(spark, folder), pulse, vol))


TODAY = dt.date(2024, 1, 30)


def todays_close(spark, folder):
    """Sessions of the last day: one instrument without bars, one with a single bar, the rest live."""
    bars = derived.intraday_bars(spark, folder)
    first_bar = F.to_timestamp(F.lit("2024-01-30 09:30:00"))
    late = (F.col("ticker") == "click") & (F.to_date("ts") == F.lit(TODAY))
    alone = (F.col("ticker") == "view") & (F.to_date("ts") == F.lit(TODAY)) & (F.col("ts") != first_bar)
    early = F.col("ts") < F.to_timestamp(F.lit("2024-01-30 14:00:00"))
    tickers = derived.event_days(spark, folder).select("ticker").distinct()
    weights = [0.1 if c == "ret_last_bar" else 0.0 for c in schemas.SNAPSHOT_FEATURES]
    fixed = tickers.select("ticker", F.lit(0.01).alias("intercept"), F.array(*[F.lit(w) for w in weights]).alias("coefficients"))
    live = bars.where(~late & ~alone & early)
    return portable(predict.todays_close(live, derived.event_days(spark, folder), fixed, F.lit(TODAY)))


def _reports(spark, folder):
    """(comparison, log, rates, checked, forecast, fundamentals) of the segments."""
    every, market = drift_queries.store(spark, folder)
    table = settle(scored_table(spark, folder))
    log = backtest.trade_log(table, COSTS)
    segments = every.where(F.col("ticker") != derived.MARKET)
    rates = drift.hit_rates(segments)
    report = comparison.ticker_comparison(_held_out(spark, folder, table), log, rates)
    facts = fundamentals.flatten_fundamentals(derived.fundamentals_info(spark, folder))
    position = F.substring_index("symbol", "#", -1).cast("int")
    names = F.array(*[F.lit(t) for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    facts = facts.where(position < 5).withColumn("ticker", names[position])
    return report, log, rates, segments, market, facts


def ticker_comparison(spark, folder):
    return portable(_reports(spark, folder)[0])


def _document(spark, folder):
    report, log, rates, segments, market, facts = _reports(spark, folder)
    return dashboard.dashboard(
        report,
        log,
        drift.horizon_pivot(rates),
        drift.expected_vs_actual(segments, market),
        drift.live_forecast(segments, market),
        facts,
    )


def dashboard_document(spark, folder):
    return sinks.as_json(_document(spark, folder), "ticker")


def dashboard_fields(spark, folder):
    """Values read back out of the nested document."""
    doc = _document(spark, folder)
    return portable(
        doc.select(
            "ticker",
            "held_out_days",
            "recent5d_correct",
            "recent5d_cum_pct",
            F.col("four_horizon")["1 year"].alias("one_year"),
            F.size("expected_vs_actual").alias("n_checked"),
            F.get("expected_vs_actual", 0)["horizon"].alias("first_checked"),
            F.get("expected_vs_actual", 1)["error_pts"].alias("second_error"),
            F.col("horizon_forecast")["6 months"]["predicted_price"].alias("six_month_price"),
            F.col("horizon_forecast")["12 months"]["historical_error_pts"].alias("year_error"),
            F.col("fundamentals.sector").alias("sector"),
            "last_price",
        )
    )


def dashboard_headlines(spark, folder):
    report, _, _, segments, market, _ = _reports(spark, folder)
    return portable(comparison.model_headlines(report, drift.expected_vs_actual(segments, market)))


def track_record_document(spark, folder):
    every, market = drift_queries.store(spark, folder)
    record = drift.horizon_track_record(drift.expected_vs_actual(every, market))
    nested = dashboard.track_record_document(record)
    entry = F.explode("horizon_track_record").alias("horizon", "v")
    return portable(nested.select(entry).select("horizon", "v.*"))


HELD = (
    "hn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY ticker) AS c FROM rows_), "
    "ht AS (SELECT *, ret_1d AS prediction FROM hn WHERE r >= c * 85 // 100), "
    "hc AS (SELECT ticker, sqrt(avg((prediction - target_return) ** 2)) AS rmse, count(*) AS n, "
    "avg(CASE WHEN target_direction = 1 THEN called_up::DOUBLE END) AS up_recall, avg(CASE WHEN target_direction = 0 THEN 1 - called_up::DOUBLE END) AS down_recall FROM ht GROUP BY 1), "
    "held AS (SELECT ticker, rmse AS held_out_test_rmse, (up_recall + down_recall) / 2 AS held_out_test_balanced_accuracy, n AS held_out_test_days, "
    "'baseline_persistence' AS regressor_type, 'baseline_persistence' AS classifier_type FROM hc)"
)
HELD_CTES = (BARS, RET1, ROWS.split(", num AS")[0], HELD)
NEXT = (
    "nl AS (SELECT ticker, date, close, ret_1d, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM ret WHERE ret_1d IS NOT NULL), "
    "nx AS (SELECT ticker, date AS last_close_date, close AS last_close, ret_1d * 100 AS predicted_return_pct, close * (1 + ret_1d) AS predicted_next_close, "
    "CASE WHEN ret_1d > 0 THEN 'UP' ELSE 'DOWN' END AS predicted_direction, CASE WHEN ret_1d > 0 THEN 0.98 ELSE 0.02 END AS up_probability, "
    "CASE ticker WHEN 'AUTOMOBILE' THEN 'positive' WHEN 'BUILDING' THEN 'no recent news' WHEN 'MACHINERY' THEN 'unavailable (fetch failed)' END AS live_news_sentiment, "
    "CASE ticker WHEN 'AUTOMOBILE' THEN 0.25 END AS live_atm_iv, CASE ticker WHEN 'AUTOMOBILE' THEN 0.04 END AS live_iv_skew FROM nl WHERE k = 1)"
)
LIVE_BARS = INTRADAY.replace("ibars AS", "ibars0 AS") + (
    ", ibars AS (SELECT * FROM ibars0 WHERE NOT (ticker = 'click' AND CAST(ts AS DATE) = DATE '2024-01-30') AND "
    "NOT (ticker = 'view' AND CAST(ts AS DATE) = DATE '2024-01-30' AND ts <> TIMESTAMP '2024-01-30 09:30:00') AND ts < TIMESTAMP '2024-01-30 14:00:00')"
)
CLOSE = (
    "ses AS (SELECT ticker, arg_max(close, ts) AS last_close, max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN ts END) AS newest_ts, "
    "arg_max(close, ts) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS newest_close FROM ibars GROUP BY 1), "
    "lv AS (SELECT * FROM snapall WHERE date = DATE '2024-01-30' AND n_bars >= 2 AND bar_no = n_bars), "
    "tc AS (SELECT ses.ticker, CASE WHEN newest_ts IS NULL THEN 'market closed (no bars yet today)' WHEN lv.ticker IS NULL THEN "
    "'not enough bars yet this session (try again in a few minutes)' WHEN minutes_until_close <= 0 THEN 'closed for the day' ELSE CAST(CAST(minutes_until_close AS BIGINT) AS VARCHAR) || ' min until close' END AS status, "
    "newest_ts AS as_of, newest_close AS current_price, price_now * (1 + (0.01::DOUBLE + 0.1::DOUBLE * ret_last_bar)) AS predicted_4pm_close, (0.01::DOUBLE + 0.1::DOUBLE * ret_last_bar) * 100 AS predicted_change_pct, "
    "CASE WHEN newest_ts IS NULL THEN last_close END AS last_session_close FROM ses LEFT JOIN lv ON lv.ticker = ses.ticker)"
)
LONG = drift_queries._shortest("0.8") + (
    ", lhc AS (SELECT ticker, CASE WHEN horizon_label IS NULL THEN 'none reliable (see long-horizon drift)' ELSE 'UP over ' || horizon_label END AS long_horizon_call, "
    "oos_hit_rate AS long_horizon_oos_hit_rate FROM short)"
)
COMPARED = (
    *drift_queries.HIT,
    RET1,
    ROWS.split(", num AS")[0],
    HELD,
    DAYS,
    RECENT,
    SUMMARY,
    LONG,
    "cmp AS (SELECT held.*, directional_accuracy AS recent_accuracy, n_correct, avg_net_bps AS recent_net_bps_per_trade, cumulative_net_pct AS recent_cumulative_pct, long_horizon_call, long_horizon_oos_hit_rate "
    "FROM held LEFT JOIN summary s ON s.ticker = held.ticker LEFT JOIN lhc ON lhc.ticker = held.ticker)",
)
SEGMENT_EVA = tuple(part for part in drift_queries.EXPECTED if part not in drift_queries.ALL)
FIELD_CTES = (
    *COMPARED,
    *SEGMENT_EVA,
    "live0 AS (SELECT ticker, horizon, date AS as_of_date, close AS last_price, trading_days FROM panel WHERE i = n - 1)",
    f"lsamp AS (SELECT p.ticker, p.horizon, p.fwd AS value, {drift_queries._decay('a.as_of_date', 'p.date')} AS weight FROM panel p JOIN live0 a "
    "ON a.ticker = p.ticker AND a.horizon = p.horizon WHERE p.fwd IS NOT NULL)",
    drift_queries._estimates("lsamp", "lest"),
    f"lmsamp AS (SELECT a.horizon, a.as_of_date, p.fwd AS value, {drift_queries._decay('a.as_of_date', 'p.date')} AS weight "
    "FROM (SELECT DISTINCT horizon, as_of_date FROM live0) a JOIN panel p ON p.horizon = a.horizon AND p.ticker = 'MARKET' AND p.fwd IS NOT NULL)",
    drift_queries._estimates("lmsamp", "lmest", "horizon, as_of_date"),
    "lf AS (SELECT a.ticker, a.horizon, a.last_price, a.last_price * (1 + (e.n // a.trading_days) / ((e.n // a.trading_days) + CAST(20 AS DOUBLE)) * e.recency_weighted_median "
    "+ (1 - (e.n // a.trading_days) / ((e.n // a.trading_days) + CAST(20 AS DOUBLE))) * m.recency_weighted_median) AS predicted_price "
    "FROM live0 a JOIN lest e ON e.ticker = a.ticker AND e.horizon = a.horizon JOIN lmest m ON m.horizon = a.horizon AND m.as_of_date = a.as_of_date)",
    FUND,
    f"ev AS (SELECT * FROM eva WHERE estimator = '{config.LIVE_ESTIMATOR}')",
    "fld AS (SELECT c.ticker, held_out_test_days AS held_out_days, n_correct AS recent5d_correct, recent_cumulative_pct AS recent5d_cum_pct, "
    "(SELECT test_hit_rate FROM rates WHERE rates.ticker = c.ticker AND rates.horizon = '1 year') AS one_year, "
    "(SELECT count(*) FROM ev WHERE ev.ticker = c.ticker) AS n_checked, "
    "(SELECT arg_min(horizon, target_date) FROM ev WHERE ev.ticker = c.ticker) AS first_checked, "
    "(SELECT list(error_pct_points ORDER BY target_date)[2] FROM ev WHERE ev.ticker = c.ticker) AS second_error, "
    "(SELECT predicted_price FROM lf WHERE lf.ticker = c.ticker AND horizon = '6 months') AS six_month_price, "
    "(SELECT error_pct_points FROM ev WHERE ev.ticker = c.ticker AND horizon = '12 months') AS year_error, "
    "(SELECT CASE WHEN trailing_pe IS NOT NULL THEN sector END FROM fu WHERE list_extract(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], CAST(split_part(symbol, '#', 2) AS INTEGER) + 1) = c.ticker AND CAST(split_part(symbol, '#', 2) AS INTEGER) < 5) AS sector, "
    "(SELECT max(last_price) FROM lf WHERE lf.ticker = c.ticker) AS last_price FROM cmp c)",
)

QUERIES = {
    "shipped_backtest": shipped_backtest,
    "held_out_test": held_out_test,
    "next_day_predictions": next_day_predictions,
    "todays_close": todays_close,
    "ticker_comparison": ticker_comparison,
    "dashboard_document": dashboard_document,
    "dashboard_fields": dashboard_fields,
    "dashboard_headlines": dashboard_headlines,
    "track_record_document": track_record_document,
}

HELD_SPEC = "ticker held_out_test_rmse:f held_out_test_balanced_accuracy:f held_out_test_days:i regressor_type classifier_type"
ORACLES = {
    "shipped_backtest": query(
        BARS,
        RET1,
        DAYS,
        RECENT,
        SUMMARY,
        emit(
            "summary",
            "ticker directional_accuracy:f n_correct:i n:i mean_abs_price_error_pct:f avg_gross_bps:f avg_net_bps:f share_profitable:f cumulative_net_pct:f",
        ),
    ),
    "held_out_test": query(*HELD_CTES, emit("held", HELD_SPEC)),
    "next_day_predictions": query(
        BARS,
        RET1,
        NEXT,
        emit(
            "nx",
            "ticker last_close_date:d last_close:f predicted_return_pct:f predicted_next_close:f predicted_direction up_probability:f live_news_sentiment live_atm_iv:f live_iv_skew:f",
        ),
    ),
    "todays_close": query(
        EVENT_DAYS,
        LIVE_BARS,
        CONTEXT,
        RUNNING,
        SNAPS,
        CLOSE,
        emit("tc", "ticker status as_of:t current_price:f predicted_4pm_close:f predicted_change_pct:f last_session_close:f"),
    ),
    "ticker_comparison": query(
        *COMPARED,
        emit(
            "cmp",
            HELD_SPEC + " recent_accuracy:f recent_net_bps_per_trade:f recent_cumulative_pct:f long_horizon_call long_horizon_oos_hit_rate:f",
        ),
    ),
    "dashboard_fields": query(
        *FIELD_CTES,
        emit(
            "fld",
            "ticker held_out_days:i recent5d_correct:i recent5d_cum_pct:f one_year:f n_checked:i first_checked second_error:f six_month_price:f year_error:f sector last_price:f",
        ),
    ),
    "dashboard_headlines": query(
        *COMPARED,
        *SEGMENT_EVA,
        "hd AS (SELECT (SELECT avg(held_out_test_balanced_accuracy) FROM cmp) AS mean_balanced_accuracy, (SELECT count(*) FROM cmp) AS n_persistence_classifiers, "
        f"avg(CASE WHEN direction_match THEN 1.0::DOUBLE ELSE 0 END) AS forecast_match_rate, avg(abs(error_pct_points)) AS forecast_mae_pts FROM eva WHERE estimator = '{config.LIVE_ESTIMATOR}' AND direction_match IS NOT NULL AND ticker <> 'MARKET')",
        emit("hd", "mean_balanced_accuracy:f n_persistence_classifiers:i forecast_match_rate:f forecast_mae_pts:f"),
    ),
    "track_record_document": drift_queries.ORACLES["horizon_track_record"],
}
