"""Long-horizon drift statistics and forecasts."""

from pyspark.sql import functions as F

from catalogue.common import ALL_BARS, BARS, MARKET, emit, portable, query
from quaymark import config
from quaymark.functions import dates, labels, weights
from quaymark.operators import drift, estimators
from quaymark.session import settle
from quaymark.sources import derived


def bars(spark, folder):
    return derived.all_bars(spark, folder)


def store(spark, folder):
    """The bar table of queries that read it several times: (all bars, the market's bars)."""
    table = settle(bars(spark, folder))
    return table, table.where(F.col("ticker") == derived.MARKET)


def forward_returns(spark, folder):
    panel = drift.forward_panel(bars(spark, folder), config.HORIZONS, "ticker")
    return portable(panel.where(F.col("fwd").isNotNull()).select("ticker", "date", "horizon", "fwd"))


def hit_rates(spark, folder):
    return portable(drift.hit_rates(bars(spark, folder)))


def four_horizon_pivot(spark, folder):
    return portable(drift.horizon_pivot(drift.hit_rates(bars(spark, folder))))


def printable_hit_rates(spark, folder):
    rates = drift.hit_rates(bars(spark, folder))
    cell = labels.hit_rate_cell(F.col("test_hit_rate"), F.col("reliable"), F.col("effective_independent_n"))
    return portable(rates.select("ticker", "horizon", cell.alias("cell")))


def shortest_reliable_horizon(spark, folder):
    """At a floor of 50%, so that these random prices have both outcomes."""
    return portable(drift.shortest_reliable(drift.hit_rates(bars(spark, folder)), 0.5))


def long_horizon_calls(spark, folder):
    return portable(drift.long_horizon_calls(store(spark, folder)[0]))


def non_overlapping_windows(spark, folder):
    return portable(drift.non_overlapping_windows(bars(spark, folder)))


def verified_calls(spark, folder):
    return portable(drift.verified_calls(drift.non_overlapping_windows(bars(spark, folder))))


def recent_completed_window(spark, folder):
    horizons = {"3 months": 63, "7 years": 1700, "20 years": 5040}
    return portable(drift.recent_windows(bars(spark, folder), horizons))


def tickers_up_count(spark, folder):
    recent = drift.recent_windows(bars(spark, folder), {"3 months": 63})
    return portable(
        recent.agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("n_up"), F.count(F.lit(1)).alias("n"))
    )


def _samples(spark, folder):
    panel = drift.forward_panel(bars(spark, folder), config.FORECAST_HORIZONS, "ticker")
    as_of = F.to_date(F.lit("2001-01-01"))
    return panel.where(F.col("fwd").isNotNull()).select(
        "ticker", "horizon", F.col("fwd").alias("value"), weights.recency_by_days(as_of, F.col("date")).alias("weight")
    )


def point_estimators(spark, folder):
    return portable(estimators.point_estimates(_samples(spark, folder), "ticker", "horizon"))


def weighted_median(spark, folder):
    return portable(estimators.weighted_median(_samples(spark, folder), "ticker", "horizon"))


def expected_vs_actual(spark, folder):
    return portable(drift.expected_vs_actual(*store(spark, folder)))


def shrunk_estimate(spark, folder):
    rows = drift.expected_vs_actual(*store(spark, folder))
    return portable(
        rows.where(F.col("estimator") == config.LIVE_ESTIMATOR).select(
            "ticker", "horizon", "expected_n_samples", "expected_return_pct"
        )
    )


def estimator_league(spark, folder):
    return portable(drift.estimator_league(drift.expected_vs_actual(*store(spark, folder))))


def best_estimator(spark, folder):
    league = drift.estimator_league(drift.expected_vs_actual(*store(spark, folder)))
    return portable(league.where(F.col("rank") == 1).select("estimator", "mae_pct_points"))


def horizon_track_record(spark, folder):
    return portable(drift.horizon_track_record(drift.expected_vs_actual(*store(spark, folder))))


def live_horizon_forecast(spark, folder):
    return portable(drift.live_forecast(*store(spark, folder)))


def business_day_offset(spark, folder):
    days = bars(spark, folder).select("date").distinct()
    spans = F.array(*[F.lit(h) for h in (1, 2, 3, 4, 5, 6, 63, 126, 189, 252, 504)])
    rows = days.withColumn("h", F.explode(spans))
    return portable(rows.withColumn("target", dates.add_business_days(F.col("date"), F.col("h"))))


def _horizon_rows(items: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in items.items()) + ") h(horizon, trading_days)"


def _panel(source: str, items: dict[str, int], keys: str = "ticker", name: str = "panel") -> str:
    """Numbered rows joined with the row ``h`` rows later."""
    return (
        f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}), "
        f"{name} AS (SELECT a.*, h.horizon, h.trading_days, b.close AS end_price, b.date AS end_date, b.close / a.close - 1 AS fwd "
        f"FROM {name}_n a CROSS JOIN {_horizon_rows(items)} LEFT JOIN {name}_n b ON b.i = a.i + h.trading_days AND "
        + " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
        + ")"
    )


SLICED = (
    "sl AS (SELECT ticker, date, close, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 < "
    "count(*) OVER (PARTITION BY ticker) * 85 // 100 THEN 'train' ELSE 'test' END AS slice FROM allbars)"
)
ALL = (BARS, MARKET, ALL_BARS)
WON = "CASE WHEN fwd IS NULL THEN NULL WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0 END"
RATES = (
    "rates AS (SELECT ticker, horizon, trading_days, "
    f"avg(CASE WHEN slice = 'train' THEN {WON} END) AS train_hit_rate, count(CASE WHEN slice = 'train' THEN fwd END) AS train_n, "
    f"avg(CASE WHEN slice = 'test' THEN {WON} END) AS test_hit_rate, count(CASE WHEN slice = 'test' THEN fwd END) AS test_n_windows, "
    "count(CASE WHEN slice = 'test' THEN fwd END) // trading_days AS effective_independent_n, "
    "count(CASE WHEN slice = 'test' THEN fwd END) >= 20 AS reliable FROM hpanel GROUP BY ticker, horizon, trading_days)"
)
HIT = (*ALL, SLICED, _panel("sl", config.HORIZONS, "ticker, slice", "hpanel"), RATES)
PIVOT = ", ".join(
    f"max(CASE WHEN horizon = '{h}' THEN test_hit_rate END) AS \"{h}\", bool_or(CASE WHEN horizon = '{h}' THEN reliable END) AS \"{h} reliable\", "
    f"max(CASE WHEN horizon = '{h}' THEN effective_independent_n END) AS \"{h} independent_n\""
    for h in config.COMPARISON_HORIZONS
)


def _shortest(floor: str) -> str:
    return (
        f"short AS (SELECT t.ticker, r.horizon AS horizon_label, r.trading_days AS horizon_days, r.test_hit_rate AS oos_hit_rate, r.train_hit_rate, "
        f"r.test_n_windows, r.effective_independent_n AS independent_n FROM (SELECT DISTINCT ticker FROM rates) t LEFT JOIN "
        f"(SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_days) AS k FROM rates WHERE test_hit_rate >= {floor} AND reliable) r "
        "ON r.ticker = t.ticker AND r.k = 1)"
    )


def bday(day: str, h: str) -> str:
    wd = f"(isodow({day}) - 1)"
    start = f"({day} - CAST(greatest({wd} - 4, 0) AS INTEGER))"
    return f"{start} + CAST({h} + 2 * ((isodow({start}) - 1 + {h}) // 5) AS INTEGER)"


CALLS = (
    "lastd AS (SELECT ticker, max(date) AS last_date FROM allbars GROUP BY 1), "
    "calls AS (SELECT s.ticker, CASE WHEN horizon_label IS NULL THEN 'no confident long-horizon call' ELSE "
    f"'UP by ~' || CAST(CAST({bday('last_date', 'horizon_days')} AS DATE) AS VARCHAR) || ' (' || horizon_label || ' out)' END AS call, "
    "oos_hit_rate AS historical_out_of_sample_hit_rate, CASE WHEN horizon_label IS NULL THEN 'n/a' WHEN independent_n <= 1 THEN "
    "'LOW -- based on essentially one independent historical window; descriptive, not validated' ELSE "
    "'based on ~' || independent_n || ' independent historical windows -- still thin by normal standards' END AS confidence, "
    "CASE WHEN horizon_label IS NULL THEN 'no horizon reliably reached 80% out-of-sample' ELSE '' END AS reason "
    "FROM short s JOIN lastd l ON l.ticker = s.ticker)"
)
VERIFY = (
    *ALL,
    SLICED,
    "tsl AS (SELECT * FROM sl WHERE slice = 'test')",
    _panel("tsl", config.VERIFY_HORIZONS),
    "wins AS (SELECT ticker, horizon, date AS start_date, end_date, close AS start_price, end_price, fwd * 100 AS return_pct, 'UP' AS predicted, fwd > 0 AS correct "
    "FROM panel WHERE i % trading_days = 0 AND end_price IS NOT NULL)",
)
RECENT_WINDOWS = (
    "rw AS (SELECT t.ticker, t.horizon, p.date AS start_date, p.end_date, p.close AS start_price, p.end_price, p.fwd * 100 AS return_pct, "
    "CASE WHEN p.date IS NULL THEN NULL ELSE 'UP' END AS predicted, p.fwd > 0 AS correct, CASE WHEN p.date IS NULL THEN 'not enough history' END AS note "
    "FROM (SELECT DISTINCT ticker, horizon FROM panel) t LEFT JOIN panel p ON p.ticker = t.ticker AND p.horizon = t.horizon AND p.i = p.n - 1 - p.trading_days)"
)
HALF_LIFE = "(CAST(504 AS DOUBLE) * CAST(365.25 AS DOUBLE) / 252)"


def _decay(as_of: str, day: str) -> str:
    return f"pow(CAST(0.5 AS DOUBLE), greatest(date_diff('day', {day}, {as_of}), 0) / {HALF_LIFE})"


def _estimates(source: str, name: str = "est", keys: str = "ticker, horizon") -> str:
    return (
        f"{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS c, "
        f"sum(weight) OVER (PARTITION BY {keys} ORDER BY value ROWS UNBOUNDED PRECEDING) AS cw, sum(weight) OVER (PARTITION BY {keys}) AS tw FROM {source}), "
        f"{name}_q AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY ALL), "
        f"{name} AS (SELECT {', '.join('r.' + k for k in keys.split(', '))}, count(*) AS n, avg(value) AS mean, max(q2) AS median, "
        "avg(CASE WHEN c < 10 OR (k >= c // 10 AND k < c * 9 // 10) THEN value END) AS trimmed_mean_10pct, "
        "avg(least(greatest(value, q1 - 1.5::DOUBLE * (q3 - q1)), q3 + 1.5::DOUBLE * (q3 - q1))) AS winsorized_mean_iqr, "
        "min(CASE WHEN cw >= tw / 2 THEN value END) AS recency_weighted_median "
        f"FROM {name}_r r JOIN {name}_q q ON "
        + " AND ".join(f"q.{k} = r.{k}" for k in keys.split(", "))
        + " GROUP BY ALL)"
    )


FIXED_DAY = "DATE '2001-01-01'"
EST_SPEC = (
    "ticker horizon n:i mean:f median:f trimmed_mean_10pct:f winsorized_mean_iqr:f recency_weighted_median:f"
)
FIXED_SAMPLES = (
    *ALL,
    _panel("allbars", config.FORECAST_HORIZONS),
    f"samp AS (SELECT ticker, horizon, fwd AS value, {_decay(FIXED_DAY, 'date')} AS weight FROM panel WHERE fwd IS NOT NULL)",
    _estimates("samp"),
)
EXPECTED = (
    *ALL,
    _panel("allbars", config.FORECAST_HORIZONS),
    "anch AS (SELECT ticker, horizon, trading_days, i AS ai, date AS anchor_date, close AS anchor_price, end_date AS target_date, end_price AS target_price, fwd AS actual "
    "FROM panel WHERE i = n - 1 - 252 AND i >= 60)",
    f"samp AS (SELECT p.ticker, p.horizon, p.fwd AS value, {_decay('a.anchor_date', 'p.date')} AS weight FROM panel p JOIN anch a "
    "ON a.ticker = p.ticker AND a.horizon = p.horizon WHERE p.i + p.trading_days < a.ai)",
    _estimates("samp"),
    f"msamp AS (SELECT a.horizon, a.anchor_date, p.fwd AS value, {_decay('a.anchor_date', 'p.date')} AS weight "
    "FROM (SELECT DISTINCT horizon, anchor_date FROM anch) a JOIN panel p ON p.horizon = a.horizon AND p.ticker = 'MARKET' AND p.end_date < a.anchor_date)",
    _estimates("msamp", "mest", "horizon, anchor_date"),
    "joined AS (SELECT a.*, coalesce(e.n, 0) AS en, mean, median, trimmed_mean_10pct, winsorized_mean_iqr, e.recency_weighted_median AS rwm, "
    "CASE WHEN m.rm IS NULL THEN e.recency_weighted_median ELSE (e.n // trading_days) / ((e.n // trading_days) + CAST(20 AS DOUBLE)) * e.recency_weighted_median "
    "+ (1 - (e.n // trading_days) / ((e.n // trading_days) + CAST(20 AS DOUBLE))) * m.rm END AS shrunk "
    "FROM anch a LEFT JOIN est e ON e.ticker = a.ticker AND e.horizon = a.horizon "
    "LEFT JOIN (SELECT horizon, anchor_date, recency_weighted_median AS rm FROM mest) m ON m.horizon = a.horizon AND m.anchor_date = a.anchor_date)",
    "cand AS ("
    + " UNION ALL ".join(
        f"SELECT *, '{name}' AS estimator, {column} AS expected FROM joined WHERE en > 0 AND actual IS NOT NULL"
        for name, column in [
            ("mean", "mean"),
            ("median", "median"),
            ("trimmed_mean_10pct", "trimmed_mean_10pct"),
            ("winsorized_mean_iqr", "winsorized_mean_iqr"),
            ("recency_weighted_median", "rwm"),
            (config.LIVE_ESTIMATOR, "shrunk"),
        ]
    )
    + " UNION ALL SELECT *, NULL, NULL FROM joined WHERE NOT (en > 0 AND actual IS NOT NULL))",
    "eva AS (SELECT ticker, horizon, estimator, anchor_date, anchor_price, expected * 100 AS expected_return_pct, en AS expected_n_samples, "
    "CASE WHEN estimator IS NOT NULL THEN target_date END AS target_date, CASE WHEN estimator IS NOT NULL THEN target_price END AS target_price, "
    "CASE WHEN estimator IS NOT NULL THEN actual * 100 END AS actual_return_pct, (actual - expected) * 100 AS error_pct_points, "
    "(expected > 0) = (actual > 0) AS direction_match FROM cand)",
)
EVA_SPEC = (
    "ticker horizon estimator anchor_date:d anchor_price:f expected_return_pct:f expected_n_samples:i target_date:d "
    "target_price:f actual_return_pct:f error_pct_points:f direction_match:b"
)
LEAGUE = (
    "lg AS (SELECT estimator, avg(abs(error_pct_points)) AS mae_pct_points, avg(CASE WHEN direction_match THEN 1.0::DOUBLE ELSE 0 END) AS direction_match_rate, "
    "count(*) AS n FROM eva WHERE direction_match IS NOT NULL GROUP BY 1), "
    "league AS (SELECT *, row_number() OVER (ORDER BY mae_pct_points, estimator) AS rank FROM lg)"
)
LIVE = (
    *HIT,
    _panel("allbars", config.FORECAST_HORIZONS),
    "heads AS (SELECT ticker, horizon, trading_days, date AS as_of_date, close AS last_price FROM panel WHERE i = n - 1)",
    f"samp AS (SELECT p.ticker, p.horizon, p.fwd AS value, {_decay('a.as_of_date', 'p.date')} AS weight FROM panel p JOIN heads a "
    "ON a.ticker = p.ticker AND a.horizon = p.horizon WHERE p.fwd IS NOT NULL)",
    _estimates("samp"),
    f"msamp AS (SELECT a.horizon, a.as_of_date, p.fwd AS value, {_decay('a.as_of_date', 'p.date')} AS weight "
    "FROM (SELECT DISTINCT horizon, as_of_date FROM heads) a JOIN panel p ON p.horizon = a.horizon AND p.ticker = 'MARKET' AND p.fwd IS NOT NULL)",
    _estimates("msamp", "mest", "horizon, as_of_date"),
    "live AS (SELECT a.ticker, a.horizon, a.as_of_date, a.last_price, "
    "(e.n // a.trading_days) / ((e.n // a.trading_days) + CAST(20 AS DOUBLE)) * e.recency_weighted_median "
    "+ (1 - (e.n // a.trading_days) / ((e.n // a.trading_days) + CAST(20 AS DOUBLE))) * m.recency_weighted_median AS x, "
    f"{bday('a.as_of_date', 'a.trading_days')} AS target_date, coalesce(e.n, 0) AS n_historical_samples, r.test_hit_rate AS oos_hit_rate, "
    "coalesce(r.reliable, FALSE) AS reliable, coalesce(r.effective_independent_n, 0) AS effective_independent_n "
    "FROM heads a LEFT JOIN est e ON e.ticker = a.ticker AND e.horizon = a.horizon "
    "LEFT JOIN mest m ON m.horizon = a.horizon AND m.as_of_date = a.as_of_date "
    "LEFT JOIN rates r ON r.ticker = a.ticker AND r.horizon = CASE WHEN a.horizon = '12 months' THEN '1 year' ELSE a.horizon END), "
    "livef AS (SELECT *, x * 100 AS expected_return_pct, last_price * (1 + x) AS predicted_price FROM live)",
)

QUERIES = {
    "forward_returns": forward_returns,
    "hit_rates": hit_rates,
    "four_horizon_pivot": four_horizon_pivot,
    "printable_hit_rates": printable_hit_rates,
    "shortest_reliable_horizon": shortest_reliable_horizon,
    "long_horizon_calls": long_horizon_calls,
    "non_overlapping_windows": non_overlapping_windows,
    "verified_calls": verified_calls,
    "recent_completed_window": recent_completed_window,
    "tickers_up_count": tickers_up_count,
    "point_estimators": point_estimators,
    "weighted_median": weighted_median,
    "expected_vs_actual": expected_vs_actual,
    "shrunk_estimate": shrunk_estimate,
    "estimator_league": estimator_league,
    "best_estimator": best_estimator,
    "horizon_track_record": horizon_track_record,
    "live_horizon_forecast": live_horizon_forecast,
    "business_day_offset": business_day_offset,
}

ORACLES = {
    "forward_returns": query(
        *ALL, _panel("allbars", config.HORIZONS), emit("panel", "ticker date:d horizon fwd:f") + " WHERE fwd IS NOT NULL"
    ),
    "hit_rates": query(
        *HIT,
        emit(
            "rates",
            "ticker horizon trading_days:i train_hit_rate:f train_n:i test_hit_rate:f test_n_windows:i effective_independent_n:i reliable:b",
        ),
    ),
    "four_horizon_pivot": query(
        *HIT,
        f"pv AS (SELECT ticker, {PIVOT} FROM rates GROUP BY 1)",
        emit(
            "pv",
            "ticker "
            + " ".join(
                f"{h.replace(' ', '~')}:f {h.replace(' ', '~')}~reliable:b {h.replace(' ', '~')}~independent_n:i"
                for h in config.COMPARISON_HORIZONS
            ),
        ),
    ),
    "printable_hit_rates": query(
        *HIT,
        "c AS (SELECT ticker, horizon, CASE WHEN test_hit_rate IS NULL THEN 'n/a' ELSE printf('%.1f%%', test_hit_rate * 100) || "
        "CASE WHEN reliable THEN '' ELSE ' (unreliable, <20 windows)' END || '  [~' || effective_independent_n || ' indep.]' END AS cell FROM rates)",
        emit("c", "ticker horizon cell"),
    ),
    "shortest_reliable_horizon": query(
        *HIT,
        _shortest("0.5"),
        emit("short", "ticker horizon_label horizon_days:i oos_hit_rate:f train_hit_rate:f test_n_windows:i independent_n:i"),
    ),
    "long_horizon_calls": query(
        *HIT,
        _shortest("0.8"),
        CALLS,
        emit("calls", "ticker call historical_out_of_sample_hit_rate:f confidence reason"),
    ),
    "non_overlapping_windows": query(
        *VERIFY,
        emit("wins", "ticker horizon start_date:d end_date:d start_price:f end_price:f return_pct:f predicted correct:b"),
    ),
    "verified_calls": query(
        *VERIFY,
        "v AS (SELECT ticker, horizon, count(*) FILTER (correct) AS n_correct, count(*) AS n_total FROM wins GROUP BY ALL)",
        emit("v", "ticker horizon n_correct:i n_total:i"),
    ),
    "recent_completed_window": query(
        *ALL,
        _panel("allbars", {"3 months": 63, "7 years": 1700, "20 years": 5040}),
        RECENT_WINDOWS,
        emit("rw", "ticker horizon start_date:d end_date:d start_price:f end_price:f return_pct:f predicted correct:b note"),
    ),
    "tickers_up_count": query(
        *ALL,
        _panel("allbars", {"3 months": 63}),
        RECENT_WINDOWS,
        "u AS (SELECT count(*) FILTER (correct) AS n_up, count(*) AS n FROM rw)",
        emit("u", "n_up:i n:i"),
    ),
    "point_estimators": query(*FIXED_SAMPLES, emit("est", EST_SPEC)),
    "weighted_median": query(
        *FIXED_SAMPLES,
        "w AS (SELECT ticker, horizon, recency_weighted_median AS weighted_median FROM est)",
        emit("w", "ticker horizon weighted_median:f"),
    ),
    "expected_vs_actual": query(*EXPECTED, emit("eva", EVA_SPEC)),
    "shrunk_estimate": query(
        *EXPECTED,
        emit("eva", "ticker horizon expected_n_samples:i expected_return_pct:f") + f" WHERE estimator = '{config.LIVE_ESTIMATOR}'",
    ),
    "estimator_league": query(
        *EXPECTED, LEAGUE, emit("league", "estimator mae_pct_points:f direction_match_rate:f n:i rank:i")
    ),
    "best_estimator": query(*EXPECTED, LEAGUE, emit("league", "estimator mae_pct_points:f") + " WHERE rank = 1"),
    "horizon_track_record": query(
        *EXPECTED,
        "tr AS (SELECT horizon, avg(abs(error_pct_points)) AS mae_pts, avg(CASE WHEN direction_match THEN 1.0::DOUBLE ELSE 0 END) AS direction_match_rate, count(*) AS n "
        f"FROM eva WHERE estimator = '{config.LIVE_ESTIMATOR}' AND error_pct_points IS NOT NULL AND direction_match IS NOT NULL GROUP BY 1)",
        emit("tr", "horizon mae_pts:f direction_match_rate:f n:i"),
    ),
    "live_horizon_forecast": query(
        *LIVE,
        emit(
            "livef",
            "ticker horizon as_of_date:d last_price:f expected_return_pct:f predicted_price:f target_date:d n_historical_samples:i "
            "oos_hit_rate:f reliable:b effective_independent_n:i",
        ),
    ),
    "business_day_offset": query(
        *ALL,
        "d AS (SELECT DISTINCT date FROM allbars)",
        "o AS (SELECT date, h, "
        + bday("date", "h")
        + " AS target FROM d, (SELECT unnest([1, 2, 3, 4, 5, 6, 63, 126, 189, 252, 504]) AS h) t)",
        emit("o", "date:d h:i target:d"),
    ),
}
