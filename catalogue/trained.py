"""Models that are trained, selected, stored in the manifest's shape and scored inside the query.

Two-factor ridge and persistence compete for every instrument's return by walk-forward score on the training
region; the winner is fitted there and serves every day. Directions are persistence, whose model has no fit.
"""

from pyspark.sql import functions as F

from catalogue.bars import FEATURE_CTES
from catalogue.common import emit, portable, query
from catalogue.models import PAIR_ROWS, TWO, _ridge_sql, own_table, persistence_models
from quaymark.operators import features
from quaymark.plans import comparison, training
from quaymark.session import settle

SETS = {"baseline": TWO}


def _kept(table):
    """What each instrument ships for its return: (ticker, task, feature_set, selection_basis, model, ...)."""
    data = features.dataset(table, TWO)
    rows = training.comparison_rows(training.grouped_candidates(data, TWO, "regression"), "baseline")
    missing = [c for c in ("accuracy", "balanced_accuracy") if c not in rows.columns]
    rows = settle(rows.withColumns({c: F.lit(None).cast("double") for c in missing}))
    return settle(training.shipped(training.winners(rows)))


def _trained(spark, folder):
    """(features, models of both tasks)."""
    table = settle(own_table(spark, folder))
    fitted = training.fit_shipped(table, _kept(table), SETS)
    directions = persistence_models(spark, folder).where("task = 'classification'")
    return table, settle(fitted.unionByName(directions))


def trained_selection(spark, folder):
    kept = _kept(settle(own_table(spark, folder)))
    columns = ["ticker", "task", "feature_set", "selection_basis", "model", "metric", "fold_mean", "fold_std"]
    return portable(kept.select(columns))


def trained_manifest(spark, folder):
    _, models = _trained(spark, folder)
    slopes = [F.get("coefficients", k).alias(f"slope_{k}") for k in range(2)]
    return portable(models.select("ticker", "task", "model", F.array_join("columns", ",").alias("columns"), "intercept", *slopes))


def trained_scores(spark, folder):
    frame = training.score_shipped(*_trained(spark, folder))
    return portable(frame.select("ticker", "date", "close", "pred_return", "up_probability", "complete"))


def trained_held_out(spark, folder):
    table, models = _trained(spark, folder)
    scored = training.score_shipped(table, models).select("ticker", "date", "pred_return", "up_probability", "complete")
    targets = table.where("target_return IS NOT NULL").select("ticker", "date", "target_return", "target_direction")
    return portable(comparison.held_out(scored, targets, models))


_LINE = "b0 + b1 * ret_1d + b2 * hl_range"
_NUMBERED = "row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS r_, count(*) OVER (PARTITION BY ticker) AS c_"
SELECTION = (
    PAIR_ROWS,
    f"tn AS (SELECT *, {_NUMBERED} FROM pr)",
    "tsp AS (SELECT * EXCLUDE (r_, c_), CASE WHEN r_ >= c_ - greatest(CAST(floor(c_ * CAST(0.15 AS DOUBLE)) AS BIGINT), 30) "
    "THEN 'test' ELSE 'train' END AS split FROM tn)",
    "ttrain AS (SELECT * FROM tsp WHERE split = 'train')",
    f"tk AS (SELECT *, {_NUMBERED} FROM ttrain)",
    "tf AS (SELECT tk.*, k AS fold, CASE WHEN r_ >= c_ - (4 - k) * (c_ // 5) THEN 'test' ELSE 'train' END AS role "
    "FROM tk, range(4) t(k) WHERE c_ // 5 >= 10 AND r_ < c_ - (3 - k) * (c_ // 5))",
    "tftrain AS (SELECT * FROM tf WHERE role = 'train')",
    _ridge_sql("ttrain", "ret_1d", "hl_range", "target_return", "ticker", "hfit"),
    _ridge_sql("tftrain", "ret_1d", "hl_range", "target_return", "ticker, fold", "ffit"),
    f"fsc AS (SELECT tf.ticker, tf.fold, sqrt(avg(({_LINE} - target_return) ** 2)) AS ridge, sqrt(avg((ret_1d - target_return) ** 2)) AS naive "
    "FROM tf JOIN ffit ON ffit.ticker = tf.ticker AND ffit.fold = tf.fold WHERE role = 'test' GROUP BY ALL)",
    "fst AS (SELECT ticker, avg(ridge) AS rm, stddev_pop(ridge) AS rs, avg(naive) AS nm, stddev_pop(naive) AS ns FROM fsc GROUP BY 1)",
    f"hst AS (SELECT tsp.ticker, sqrt(avg(({_LINE} - target_return) ** 2)) AS rh, sqrt(avg((ret_1d - target_return) ** 2)) AS nh "
    "FROM tsp JOIN hfit ON hfit.ticker = tsp.ticker WHERE split = 'test' GROUP BY 1)",
    "won AS (SELECT hst.*, fst.* EXCLUDE (ticker), CASE WHEN coalesce(rm + rs / 2 <= nm + ns / 2, rh <= nh) THEN 'linear_ridge' "
    "ELSE 'baseline_persistence' END AS model FROM hst LEFT JOIN fst ON fst.ticker = hst.ticker)",
)
SCORED = (
    f"tsc AS (SELECT feat.ticker, date, close, ret_1d, target_return, target_direction, model, CASE WHEN model = 'linear_ridge' THEN {_LINE} "
    "ELSE ret_1d END AS pred FROM feat JOIN won ON won.ticker = feat.ticker JOIN hfit ON hfit.ticker = feat.ticker)"
)

QUERIES = {
    "trained_selection": trained_selection,
    "trained_manifest": trained_manifest,
    "trained_scores": trained_scores,
    "trained_held_out": trained_held_out,
}

ORACLES = {
    "trained_selection": query(
        *FEATURE_CTES,
        *SELECTION,
        "s AS (SELECT ticker, 'regression' AS task, 'baseline' AS feature_set, CASE WHEN rm IS NULL THEN 'single_holdout_fallback' ELSE 'walk_forward' END AS selection_basis, "
        "model, CASE WHEN model = 'linear_ridge' THEN rh ELSE nh END AS metric, CASE WHEN model = 'linear_ridge' THEN rm ELSE nm END AS fold_mean, "
        "CASE WHEN model = 'linear_ridge' THEN rs ELSE ns END AS fold_std FROM won)",
        emit("s", "ticker task feature_set selection_basis model metric:f fold_mean:f fold_std:f"),
    ),
    "trained_manifest": query(
        *FEATURE_CTES,
        *SELECTION,
        "m AS (SELECT won.ticker, 'regression' AS task, model, CASE WHEN model = 'linear_ridge' THEN 'ret_1d,hl_range' ELSE 'ret_1d' END AS columns, "
        "CASE WHEN model = 'linear_ridge' THEN b0 ELSE 0 END AS intercept, CASE WHEN model = 'linear_ridge' THEN b1 ELSE 1 END AS slope_0, "
        "CASE WHEN model = 'linear_ridge' THEN b2 END AS slope_1 FROM won JOIN hfit ON hfit.ticker = won.ticker UNION ALL "
        "SELECT DISTINCT ticker, 'classification', 'baseline_persistence', 'ret_1d', CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), NULL FROM bars)",
        emit("m", "ticker task model columns intercept:f slope_0:f slope_1:f"),
    ),
    "trained_scores": query(
        *FEATURE_CTES,
        *SELECTION,
        SCORED,
        "s AS (SELECT ticker, date, close, pred AS pred_return, CASE WHEN ret_1d IS NULL THEN NULL WHEN ret_1d > 0 THEN 0.98 ELSE 0.02 END AS up_probability, "
        "pred IS NOT NULL AND ret_1d IS NOT NULL AS complete FROM tsc)",
        emit("s", "ticker date:d close:f pred_return:f up_probability:f complete:b"),
    ),
    "trained_held_out": query(
        *FEATURE_CTES,
        *SELECTION,
        SCORED,
        f"hn AS (SELECT *, {_NUMBERED} FROM tsc WHERE pred IS NOT NULL AND ret_1d IS NOT NULL AND target_return IS NOT NULL)",
        "ht AS (SELECT *, CASE WHEN ret_1d > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS up_ FROM hn WHERE r_ >= c_ * 85 // 100)",
        "hc AS (SELECT ticker, sqrt(avg((pred - target_return) ** 2)) AS held_out_test_rmse, count(*) AS held_out_test_days, max(model) AS regressor_type, "
        "(avg(CASE WHEN target_direction = 1 THEN up_ END) + avg(CASE WHEN target_direction = 0 THEN 1 - up_ END)) / 2 AS held_out_test_balanced_accuracy, "
        "'baseline_persistence' AS classifier_type FROM ht GROUP BY 1)",
        emit("hc", "ticker held_out_test_rmse:f held_out_test_balanced_accuracy:f held_out_test_days:i regressor_type classifier_type"),
    ),
}
