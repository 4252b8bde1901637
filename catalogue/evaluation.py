"""Splits, folds, weights, metrics, selection and the backtest."""

import datetime as dt

from pyspark.sql import functions as F

from catalogue.bars import RET1
from catalogue.common import BARS, emit, portable, query
from quaymark import config
from quaymark.functions import windows, weights
from quaymark.operators import backtest, baselines, metrics, selection, splits
from quaymark.session import settle
from quaymark.sources import derived

COSTS = {"AUTOMOBILE": 2, "BUILDING": 3, "FURNITURE": 8}


def returns(spark, folder):
    """(ticker, date, close, ret_1d, target_return, target_direction), complete rows."""
    spec = windows.calendar("ticker")
    frame = derived.daily_bars(spark, folder).select("ticker", "date", "close")
    frame = frame.withColumn("ret_1d", windows.change(F.col("close"), 1, spec))
    frame = frame.withColumn("target_return", F.lead("ret_1d", 1).over(spec))
    return frame.where(F.col("ret_1d").isNotNull() & F.col("target_return").isNotNull()).withColumn(
        "target_direction", (F.col("target_return") > 0).cast("int")
    )


def persistence(spark, folder):
    """The persistence forecast of every complete row."""
    return returns(spark, folder).withColumns(
        {
            "prediction": baselines.persistence_return(),
            "up_probability": baselines.persistence_probability(),
            "called_up": (baselines.persistence_probability() > config.UP_THRESHOLD).cast("int"),
        }
    )


def split_counts(spark, folder):
    return portable(splits.split_audit(splits.chrono_split(returns(spark, folder), "ticker"), "ticker"))


def share_split_counts(spark, folder):
    return portable(splits.split_audit(splits.share_split(returns(spark, folder), "ticker"), "ticker"))


def expanding_folds(spark, folder):
    folds = splits.expanding_folds(returns(spark, folder), "ticker")
    return portable(
        folds.groupBy("ticker", "fold", "role").agg(
            F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
        )
    )


def recency_weights(spark, folder):
    return portable(
        returns(spark, folder).select(
            "ticker",
            "date",
            weights.recency_by_rows("ticker").alias("by_rows"),
            weights.recency_by_days(F.lit(dt.date(2000, 1, 1)), F.col("date")).alias("by_days"),
        )
    )


def class_weights(spark, folder):
    frame = returns(spark, folder).select(
        "ticker",
        "date",
        (weights.balanced_class("target_direction", "ticker") * weights.recency_by_rows("ticker")).alias("weight"),
    )
    return portable(frame)


def regression_metrics(spark, folder):
    test = splits.chrono_split(persistence(spark, folder), "ticker").where(F.col("split") == "test")
    zero = test.withColumn("prediction", baselines.zero_return()).withColumn("model", F.lit("baseline_zero_return"))
    both = test.withColumn("model", F.lit("baseline_persistence")).unionByName(zero)
    return portable(metrics.regression_metrics(both, "ticker", "model"))


def classification_metrics(spark, folder):
    marked = settle(splits.chrono_split(persistence(spark, folder), "ticker"))
    test = marked.where(F.col("split") == "test")
    majority = baselines.majority_class(marked.where(F.col("split") == "train"), "ticker")
    floor = test.join(majority, "ticker").withColumns(
        {"called_up": F.col("majority"), "model": F.lit("baseline_majority")}
    )
    both = test.withColumn("model", F.lit("baseline_persistence")).unionByName(floor.drop("majority"))
    return portable(metrics.classification_metrics(both, "ticker", "model"))


def fold_scores(spark, folder):
    """Persistence scored on every expanding fold, both tasks in long form."""
    test = splits.expanding_folds(persistence(spark, folder), "ticker").where(F.col("role") == "test")
    keys = ("ticker", "fold")
    rmse = metrics.regression_metrics(test, *keys).select(*keys, F.lit("regression").alias("task"), F.col("rmse").alias("score"))
    accuracy = metrics.classification_metrics(test, *keys).select(
        *keys, F.lit("classification").alias("task"), F.col("balanced_accuracy").alias("score")
    )
    return rmse.unionByName(accuracy)


def fold_stability(spark, folder):
    return portable(metrics.fold_statistics(fold_scores(spark, folder), "ticker", "task"))


def _candidates(spark, folder):
    """Segments play the candidates of one market: their persistence fold statistics compete."""
    stats = metrics.fold_statistics(fold_scores(spark, folder), "ticker", "task")
    test = splits.chrono_split(persistence(spark, folder), "ticker").where(F.col("split") == "test")
    rmse = metrics.regression_metrics(test, "ticker").select("ticker", F.lit("regression").alias("task"), F.col("rmse").alias("metric"))
    accuracy = metrics.classification_metrics(test, "ticker").select(
        "ticker", F.lit("classification").alias("task"), F.col("balanced_accuracy").alias("metric")
    )
    return (
        stats.join(rmse.unionByName(accuracy), ["ticker", "task"])
        .withColumnRenamed("ticker", "model")
        .withColumn("ordinal", F.length("model"))
        .withColumn("grp", F.when(F.col("model") < "F", F.lit("early")).otherwise(F.lit("late")))
    )


def pessimistic_selection(spark, folder):
    return portable(selection.select_models(_candidates(spark, folder), "grp"))


def selection_fallback(spark, folder):
    """Without fold scores the hold-out metric decides."""
    nothing = F.lit(None).cast("double")
    unfolded = _candidates(spark, folder).withColumns({"fold_mean": nothing, "fold_std": nothing})
    return portable(selection.select_models(unfolded, "grp").select("grp", "task", "selection_basis", "model", "metric"))


def feature_set_selection(spark, folder):
    winners = selection.select_models(_candidates(spark, folder), "grp")
    named = winners.withColumn("set_ordinal", F.when(F.col("grp") == "early", 0).otherwise(1))
    return portable(
        selection.select_feature_sets(named.withColumn("_all", F.lit(1)), "_all").select("task", "grp", "model", "metric")
    )


def scored_days(spark, folder):
    """Every day with the persistence forecast made on it for the next day."""
    spec = windows.calendar("ticker")
    frame = derived.daily_bars(spark, folder).select("ticker", "date", "close")
    frame = frame.withColumn("ret_1d", windows.change(F.col("close"), 1, spec))
    return frame.select(
        "ticker",
        "date",
        "close",
        baselines.persistence_return().alias("pred_return"),
        baselines.persistence_probability().alias("up_probability"),
        F.col("ret_1d").isNotNull().alias("complete"),
    )


def full_log(spark, folder):
    return backtest.trade_log(scored_days(spark, folder), COSTS, days=None)


def persistence_backtest_summary(spark, folder):
    return portable(backtest.log_summary(full_log(spark, folder)))


def recent_backtest(spark, folder):
    return portable(backtest.trade_log(scored_days(spark, folder), COSTS))


REQUESTED = [dt.date(1995, 1, 1), dt.date(1995, 1, 2), dt.date(1996, 7, 4), dt.date(1998, 3, 3), dt.date(2012, 1, 1)]


def backtest_notes(spark, folder):
    return portable(backtest.trade_log_for(scored_days(spark, folder), REQUESTED, COSTS))


def backtest_accuracy_rollup(spark, folder):
    return portable(backtest.log_summary(backtest.trade_log(scored_days(spark, folder), COSTS)))


def recent_stats(spark, folder):
    return portable(backtest.recent_stats(backtest.trade_log(scored_days(spark, folder), COSTS)))


def drawdown_path(spark, folder):
    return portable(backtest.drawdown_path(backtest.trade_log(scored_days(spark, folder), COSTS)))


def drawdown(spark, folder):
    return portable(backtest.drawdown(backtest.trade_log(scored_days(spark, folder), COSTS)))


ROWS = (
    "tgt AS (SELECT ticker, date, close, ret_1d, lead(ret_1d) OVER (PARTITION BY ticker ORDER BY date) AS target_return FROM ret), "
    "rows_ AS (SELECT *, CASE WHEN target_return > 0 THEN 1 ELSE 0 END AS target_direction, "
    "CASE WHEN ret_1d > 0 THEN 1 ELSE 0 END AS called_up FROM tgt WHERE ret_1d IS NOT NULL AND target_return IS NOT NULL), "
    "num AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY ticker) AS c FROM rows_), "
    "spl AS (SELECT *, CASE WHEN r >= c - greatest(c * 15 // 100, 30) THEN 'test' ELSE 'train' END AS split, "
    "CASE WHEN r >= c * 85 // 100 THEN 'test' ELSE 'train' END AS share FROM num)"
)
BASE = (BARS, RET1, ROWS)
FOLDS = (
    "foldrows AS (SELECT num.*, k AS fold, CASE WHEN r >= c - (4 - k) * (c // 5) THEN 'test' ELSE 'train' END AS role "
    "FROM num, range(4) t(k) WHERE c // 5 >= 10 AND r < c - (3 - k) * (c // 5))"
)
CLASS = (
    "sum(CASE WHEN called_up = 1 AND target_direction = 1 THEN 1.0::DOUBLE ELSE 0 END) AS tp, "
    "sum(CASE WHEN called_up = 1 AND target_direction = 0 THEN 1.0::DOUBLE ELSE 0 END) AS fp, "
    "sum(CASE WHEN called_up = 0 AND target_direction = 1 THEN 1.0::DOUBLE ELSE 0 END) AS fn, "
    "sum(CASE WHEN called_up = 0 AND target_direction = 0 THEN 1.0::DOUBLE ELSE 0 END) AS tn"
)
BALANCED = (
    "(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / "
    "(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END)"
)
REG = (
    "sqrt(avg((prediction - target_return) ** 2)) AS rmse, avg(abs(prediction - target_return)) AS mae, "
    "avg(CASE WHEN sign(prediction) = sign(target_return) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy"
)
FOLD_SCORES = (
    "conf AS (SELECT ticker, fold, " + CLASS + " FROM foldrows WHERE role = 'test' GROUP BY ALL), "
    "fscore AS (SELECT ticker, fold, 'regression' AS task, sqrt(avg((ret_1d - target_return) ** 2)) AS score FROM foldrows WHERE role = 'test' GROUP BY ALL "
    "UNION ALL SELECT ticker, fold, 'classification', " + BALANCED + " FROM conf), "
    "fstat AS (SELECT ticker, task, avg(score) AS fold_mean, stddev_pop(score) AS fold_std, count(score) AS n_folds FROM fscore GROUP BY ALL)"
)
CANDIDATES = (
    "tconf AS (SELECT ticker, " + CLASS + " FROM spl WHERE split = 'test' GROUP BY ALL), "
    "hold AS (SELECT ticker, 'regression' AS task, sqrt(avg((ret_1d - target_return) ** 2)) AS metric FROM spl WHERE split = 'test' GROUP BY ALL "
    "UNION ALL SELECT ticker, 'classification', " + BALANCED + " FROM tconf), "
    "cand AS (SELECT f.ticker AS model, f.task, fold_mean, fold_std, metric, length(f.ticker) AS ordinal, "
    "CASE WHEN f.ticker < 'F' THEN 'early' ELSE 'late' END AS grp, "
    "CASE WHEN f.task = 'regression' THEN fold_mean + fold_std / 2 ELSE fold_std / 2 - fold_mean END AS cost, "
    "CASE WHEN f.task = 'regression' THEN metric ELSE -metric END AS hcost "
    "FROM fstat f JOIN hold h ON h.ticker = f.ticker AND h.task = f.task), "
    "picked AS (SELECT *, row_number() OVER (PARTITION BY grp, task ORDER BY cost, ordinal) AS k, "
    "row_number() OVER (PARTITION BY grp, task ORDER BY hcost, ordinal) AS hk FROM cand)"
)
DAYS = (
    "scored AS (SELECT ticker, date, close, ret_1d AS pred, CASE WHEN ret_1d > 0 THEN 'UP' ELSE 'DOWN' END AS pdir FROM ret), "
    "prior AS (SELECT ticker, date, close AS actual_close, lag(close) OVER w AS prior_close, lag(pred) OVER w AS pred, lag(pdir) OVER w AS pdir, "
    "row_number() OVER w AS day_no, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age, "
    "CASE ticker " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COSTS.items()) + " ELSE 5 END AS cost "
    "FROM scored WINDOW w AS (PARTITION BY ticker ORDER BY date)), "
    "outc AS (SELECT *, prior_close * (1 + pred) AS predicted_close, actual_close / prior_close - 1 AS ar FROM prior), "
    "logall AS (SELECT ticker, date, age, day_no, pred IS NOT NULL AS ok, prior_close, predicted_close, actual_close, "
    "predicted_close - actual_close AS price_error, (predicted_close - actual_close) / actual_close * 100 AS price_error_pct, "
    "pdir AS predicted_direction, CASE WHEN ar > 0 THEN 'UP' ELSE 'DOWN' END AS actual_direction, "
    "pdir = CASE WHEN ar > 0 THEN 'UP' ELSE 'DOWN' END AS direction_correct, "
    "CASE WHEN pdir = 'UP' THEN ar ELSE -ar END * 10000 AS gross_return_bps, CAST(cost AS DOUBLE) AS assumed_cost_bps, "
    "CASE WHEN pdir = 'UP' THEN ar ELSE -ar END * 10000 - cost AS net_return_bps FROM outc)"
)
LOG_COLUMNS = (
    "prior_close:f predicted_close:f actual_close:f price_error:f price_error_pct:f predicted_direction "
    "actual_direction direction_correct:b gross_return_bps:f assumed_cost_bps:f net_return_bps:f"
)
LOG_NAMES = [word.partition(":")[0] for word in LOG_COLUMNS.split()]
NULLED = ", ".join(f"CASE WHEN note IS NULL THEN {c} END AS {c}" for c in LOG_NAMES)
RECENT = (
    "recent AS (SELECT *, CASE WHEN NOT ok THEN 'feature row incomplete (NaN)' END AS note FROM logall WHERE age <= 30 AND day_no > 1), "
    f"log_ AS (SELECT ticker, date, note, {NULLED} FROM recent)"
)
SUMMARY = (
    "summary AS (SELECT ticker, avg(CASE WHEN direction_correct THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy, "
    "count(*) FILTER (direction_correct) AS n_correct, count(*) AS n, avg(abs(price_error_pct)) AS mean_abs_price_error_pct, "
    "avg(gross_return_bps) AS avg_gross_bps, avg(net_return_bps) AS avg_net_bps, "
    "avg(CASE WHEN net_return_bps > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_profitable, sum(net_return_bps) / 100 AS cumulative_net_pct "
    "FROM log_ WHERE direction_correct IS NOT NULL GROUP BY ROLLUP (ticker))"
)
SUMMARY_SPEC = (
    "ticker directional_accuracy:f n_correct:i n:i mean_abs_price_error_pct:f avg_gross_bps:f avg_net_bps:f "
    "share_profitable:f cumulative_net_pct:f"
)
CURVE = (
    "curve AS (SELECT ticker, date, sum(net_return_bps) OVER w / 100 AS cum_net_pct FROM log_ WHERE direction_correct IS NOT NULL "
    "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)), "
    "path AS (SELECT *, cum_net_pct - max(cum_net_pct) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS drawdown_pct FROM curve)"
)

QUERIES = {
    "persistence_backtest_summary": persistence_backtest_summary,
    "chrono_split_counts": split_counts,
    "share_split_counts": share_split_counts,
    "expanding_folds": expanding_folds,
    "recency_weights": recency_weights,
    "class_weights": class_weights,
    "regression_metrics": regression_metrics,
    "classification_metrics": classification_metrics,
    "fold_stability": fold_stability,
    "pessimistic_selection": pessimistic_selection,
    "selection_fallback": selection_fallback,
    "feature_set_selection": feature_set_selection,
    "recent_backtest": recent_backtest,
    "backtest_notes": backtest_notes,
    "backtest_accuracy_rollup": backtest_accuracy_rollup,
    "recent_stats": recent_stats,
    "drawdown_path": drawdown_path,
    "drawdown": drawdown,
}


def _split_sql(column):
    return query(
        *BASE,
        f"a AS (SELECT ticker, {column} AS split, count(*) AS n_rows, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date FROM spl GROUP BY ALL)",
        emit("a", "ticker split n_rows:i n_days:i first_date:d last_date:d"),
    )


ORACLES = {
    "persistence_backtest_summary": query(
        BARS, RET1, DAYS, f"log_ AS (SELECT ticker, {', '.join(LOG_NAMES)} FROM logall WHERE ok)", SUMMARY, emit("summary", SUMMARY_SPEC)
    ),
    "chrono_split_counts": _split_sql("split"),
    "share_split_counts": _split_sql("share"),
    "expanding_folds": query(
        *BASE,
        FOLDS,
        "a AS (SELECT ticker, fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM foldrows GROUP BY ALL)",
        emit("a", "ticker fold:i role n:i first_date:d last_date:d"),
    ),
    "recency_weights": query(
        *BASE,
        "w AS (SELECT ticker, date, pow(CAST(0.5 AS DOUBLE), (c - 1 - r) / CAST(504 AS DOUBLE)) AS by_rows, "
        "pow(CAST(0.5 AS DOUBLE), greatest(date_diff('day', date, DATE '2000-01-01'), 0) / (CAST(504 AS DOUBLE) * CAST(365.25 AS DOUBLE) / 252)) AS by_days FROM num)",
        emit("w", "ticker date:d by_rows:f by_days:f"),
    ),
    "class_weights": query(
        *BASE,
        "w AS (SELECT ticker, date, c / (CAST(2 AS DOUBLE) * count(*) OVER (PARTITION BY ticker, target_direction)) * pow(CAST(0.5 AS DOUBLE), (c - 1 - r) / CAST(504 AS DOUBLE)) AS weight FROM num)",
        emit("w", "ticker date:d weight:f"),
    ),
    "regression_metrics": query(
        *BASE,
        "p AS (SELECT *, 'baseline_persistence' AS model, ret_1d AS prediction FROM spl WHERE split = 'test' UNION ALL "
        "SELECT *, 'baseline_zero_return', CAST(0 AS DOUBLE) FROM spl WHERE split = 'test')",
        f"m AS (SELECT ticker, model, {REG} FROM p GROUP BY ALL)",
        emit("m", "ticker model rmse:f mae:f directional_accuracy:f"),
    ),
    "classification_metrics": query(
        *BASE,
        "maj AS (SELECT ticker, CASE WHEN sum(target_direction) * 2 > count(*) THEN 1 ELSE 0 END AS m FROM spl WHERE split = 'train' GROUP BY 1)",
        "p AS (SELECT ticker, 'baseline_persistence' AS model, called_up, target_direction FROM spl WHERE split = 'test' UNION ALL "
        "SELECT spl.ticker, 'baseline_majority', m, target_direction FROM spl JOIN maj ON maj.ticker = spl.ticker WHERE split = 'test')",
        f"k AS (SELECT ticker, model, {CLASS} FROM p GROUP BY ALL)",
        f"m AS (SELECT ticker, model, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {BALANCED} AS balanced_accuracy, "
        "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
        "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS pct_predicted_up FROM k)",
        emit("m", "ticker model accuracy:f balanced_accuracy:f precision:f recall:f f1:f pct_predicted_up:f"),
    ),
    "fold_stability": query(*BASE, FOLDS, FOLD_SCORES, emit("fstat", "ticker task fold_mean:f fold_std:f n_folds:i")),
    "pessimistic_selection": query(
        *BASE,
        FOLDS,
        FOLD_SCORES,
        CANDIDATES,
        "w AS (SELECT *, 'walk_forward' AS selection_basis FROM picked WHERE k = 1)",
        emit("w", "grp task selection_basis model ordinal:i metric:f fold_mean:f fold_std:f"),
    ),
    "selection_fallback": query(
        *BASE,
        FOLDS,
        FOLD_SCORES,
        CANDIDATES,
        "w AS (SELECT *, 'single_holdout_fallback' AS selection_basis FROM picked WHERE hk = 1)",
        emit("w", "grp task selection_basis model metric:f"),
    ),
    "feature_set_selection": query(
        *BASE,
        FOLDS,
        FOLD_SCORES,
        CANDIDATES,
        "w AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY cost, grp) AS best FROM picked WHERE k = 1)",
        emit("w", "task grp model metric:f") + " WHERE best = 1",
    ),
    "recent_backtest": query(BARS, RET1, DAYS, RECENT, emit("log_", f"ticker date:d {LOG_COLUMNS} note")),
    "backtest_notes": query(
        BARS,
        RET1,
        DAYS,
        "asked AS (SELECT ticker, d AS date FROM (SELECT DISTINCT ticker FROM bars), (SELECT unnest(["
        + ", ".join(f"DATE '{d}'" for d in REQUESTED)
        + "]) AS d))",
        "j AS (SELECT asked.ticker, asked.date, CASE WHEN l.day_no IS NULL THEN 'no trading data for this date' "
        "WHEN l.day_no = 1 THEN 'no prior day available' WHEN NOT ok THEN 'feature row incomplete (NaN)' END AS note, "
        "l.* EXCLUDE (ticker, date) FROM asked LEFT JOIN logall l ON l.ticker = asked.ticker AND l.date = asked.date)",
        f"log_ AS (SELECT ticker, date, note, {NULLED} FROM j)",
        emit("log_", f"ticker date:d {LOG_COLUMNS} note"),
    ),
    "backtest_accuracy_rollup": query(BARS, RET1, DAYS, RECENT, SUMMARY, emit("summary", SUMMARY_SPEC)),
    "recent_stats": query(
        BARS,
        RET1,
        DAYS,
        RECENT,
        SUMMARY,
        "s AS (SELECT ticker, directional_accuracy AS recent_accuracy, avg_net_bps AS recent_net_bps_per_trade, "
        "cumulative_net_pct AS recent_cumulative_pct FROM summary WHERE ticker IS NOT NULL)",
        emit("s", "ticker recent_accuracy:f recent_net_bps_per_trade:f recent_cumulative_pct:f"),
    ),
    "drawdown_path": query(BARS, RET1, DAYS, RECENT, CURVE, emit("path", "ticker date:d cum_net_pct:f drawdown_pct:f")),
    "drawdown": query(
        BARS,
        RET1,
        DAYS,
        RECENT,
        CURVE,
        "d AS (SELECT ticker, min(drawdown_pct) AS max_drawdown_pct, CAST(-8 AS DOUBLE) AS stop_threshold_pct, "
        "min(CASE WHEN drawdown_pct <= -8 THEN date END) AS would_have_stopped_on FROM path GROUP BY 1)",
        emit("d", "ticker max_drawdown_pct:f stop_threshold_pct:f would_have_stopped_on:d"),
    ),
}
