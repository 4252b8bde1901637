"""Training on chosen columns: all instruments, the three feature sets and both tasks in one run."""

from pyspark.sql import functions as F

from catalogue.bars import FEATURE_CTES
from catalogue.common import emit, portable, query
from catalogue.macro import ALIGNED, ENHANCED, MACRO_CTES
from catalogue.models import WITH_NEWS, full_table
from catalogue.news import CARRIED, NEWS_CTES, TICKER_NEWS
from quaymark import schemas
from quaymark.models import blocks
from quaymark.operators import selection
from quaymark.plans import selected, training
from quaymark.session import settle

SETS = schemas.FEATURE_SETS


def _marked(spark, folder):
    return settle(blocks.marked(full_table(spark, folder), SETS))


def selected_ridge_certificate(spark, folder):
    """Ridge on 20 chosen columns of every set solves its normal equations, in every training region."""
    rows = _marked(spark, folder)
    chosen = settle(selected.choose(blocks.by_set(rows, SETS), SETS))
    own = chosen.where("task = 'regression'").drop("task")
    sums = blocks.training_moments(rows, SETS).join(own, ["ticker", "feature_set"])
    fitted = settle(blocks.solve_ridge(sums, len(blocks.all_columns(SETS))).withColumn("task", F.lit("regression")))
    told = selected.normal_equations(rows, fitted, SETS)
    return portable(told.select("ticker", "feature_set", "fold", "n_rows", "n_columns", (F.col("gap") < 1e-9).alias("solved")))


def training_baselines(spark, folder):
    """Comparison rows of persistence and the floors on every set, from the marked rows that the models use."""
    served = blocks.by_set(_marked(spark, folder), SETS)
    none = spark.createDataFrame([], "ticker string, feature_set string, fold int, task string, places array<int>, intercept double, coefficients array<double>")
    scores = selected.region_metrics(selected.predictions(served, none, SETS))
    return portable(selected.comparison(settle(scores)))


def training_run(spark, folder):
    """The whole run, told by what must hold: one winner of least cost, served columns, walk-forward rows."""
    run = selected.train(settle(full_table(spark, folder)))
    metric = F.when(F.col("task") == "regression", F.col("rmse")).otherwise(F.col("balanced_accuracy"))
    folded = selection.selection_cost(F.col("task"), F.col("selection_fold_mean"), F.col("selection_fold_std"))
    judged = run.comparison.withColumns({
        "cost": folded, "alone": selection.holdout_cost(F.col("task"), metric), "free": ~F.col("model").isin(selection.FLOORS)
    })
    best = judged.groupBy("ticker", "task").agg(
        F.count("*").alias("n_compared"),
        F.min(F.when(F.col("free"), F.col("cost"))).alias("least"),
        F.min(F.when(F.col("free"), F.col("alone"))).alias("least_alone"),
    )
    kept_cost = F.coalesce(
        selection.selection_cost(F.col("task"), F.col("fold_mean"), F.col("fold_std")), selection.holdout_cost(F.col("task"), F.col("metric"))
    )
    kept = run.kept.withColumn("cost", kept_cost).select("ticker", "task", "feature_set", "cost")
    shipped = run.manifest.select(
        "ticker", "task", F.size("columns").alias("n_columns"), F.size("coefficients").alias("n_coefficients"),
        (F.col("model") == training.PERSISTENCE).alias("naive"),
    )
    told = best.join(kept, ["ticker", "task"]).join(shipped, ["ticker", "task"]).join(
        run.stability.select("ticker", "task", "n_folds", F.col("single_window_metric").isNotNull().alias("has_metric")), ["ticker", "task"]
    )
    fits = (F.col("n_columns") == F.when(F.col("naive"), 1).otherwise(20)) & (F.col("n_columns") == F.col("n_coefficients"))
    return portable(
        told.select(
            "ticker", "task", "n_compared", (F.abs(F.col("cost") - F.coalesce("least", "least_alone")) < 1e-12).alias("least_cost"),
            fits.alias("columns_fit"), "has_metric", "n_folds",
        )
    )


def training_comparison(spark, folder):
    """Every linear candidate, baseline and floor on every set and task."""
    rows = _marked(spark, folder)
    served = blocks.by_set(rows, SETS)
    chosen = settle(selected.choose(served, SETS))
    fitted = settle(selected.fit_regions(rows, served, chosen, SETS))
    return portable(selected.comparison(settle(selected.region_metrics(selected.predictions(served, fitted, SETS)))))


FULL = (*FEATURE_CTES, *MACRO_CTES, ALIGNED, ENHANCED, *NEWS_CTES, TICKER_NEWS, CARRIED, WITH_NEWS)


def _complete(name: str) -> str:
    present = " AND ".join(f'"{c}" IS NOT NULL' for c in SETS[name])
    return (
        f"SELECT '{name}' AS feature_set, ticker, date, ret_1d, target_return AS y, target_direction AS d FROM full_ "
        f"WHERE target_return IS NOT NULL AND target_direction IS NOT NULL AND {present}"
    )


REGIONS = (
    f"sets AS ({' UNION ALL '.join(_complete(s) for s in SETS)})",
    "sn AS (SELECT *, row_number() OVER (PARTITION BY feature_set, ticker ORDER BY date) - 1 AS r, "
    "count(*) OVER (PARTITION BY feature_set, ticker) AS c FROM sets)",
    "sp AS (SELECT *, c - greatest(CAST(floor(c * CAST(0.15 AS DOUBLE)) AS BIGINT), 30) AS n FROM sn)",
    "folds AS (SELECT DISTINCT feature_set, ticker, k AS fold, CASE WHEN k = -1 THEN n ELSE n - (4 - k) * (n // 5) END AS a, "
    "CASE WHEN k = -1 THEN c ELSE n - (3 - k) * (n // 5) END AS b FROM sp, range(-1, 4) t(k) WHERE k = -1 OR n // 5 >= 10)",
    "trained AS (SELECT sp.*, fold FROM sp JOIN folds USING (feature_set, ticker) WHERE r < a)",
    "tested AS (SELECT sp.*, fold FROM sp JOIN folds USING (feature_set, ticker) WHERE r >= a AND r < b)",
)
SCORES = (
    "treg AS (SELECT ticker, feature_set, fold, 'regression' AS task, model, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, "
    "avg(CASE WHEN sign(p) = sign(y) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS directional_accuracy FROM "
    "(SELECT *, 'baseline_persistence' AS model, ret_1d AS p FROM tested UNION ALL SELECT *, 'baseline_zero_return', 0 FROM tested) GROUP BY ALL)",
    "major AS (SELECT ticker, feature_set, fold, CASE WHEN sum(d) * 2 > count(*) THEN 1 ELSE 0 END AS up FROM trained GROUP BY ALL)",
    "tcalls AS (SELECT tested.*, 'baseline_persistence' AS model, ret_1d > 0 AS u FROM tested JOIN major USING (ticker, feature_set, fold) UNION ALL "
    "SELECT tested.*, 'baseline_majority', up = 1 FROM tested JOIN major USING (ticker, feature_set, fold))",
    "tcm AS (SELECT ticker, feature_set, fold, model, CAST(count_if(u AND d = 1) AS DOUBLE) AS tp, CAST(count_if(u AND d <> 1) AS DOUBLE) AS fp, "
    "CAST(count_if(NOT u AND d = 1) AS DOUBLE) AS fn, CAST(count_if(NOT u AND d <> 1) AS DOUBLE) AS tn FROM tcalls GROUP BY ALL)",
    "tclf AS (SELECT ticker, feature_set, fold, 'classification' AS task, model, (tp + tn) / (tp + fp + fn + tn) AS accuracy, "
    "(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT) AS balanced_accuracy, "
    "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, "
    "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS pct_predicted_up FROM tcm)",
    "tboth AS (SELECT * FROM treg UNION ALL BY NAME SELECT * FROM tclf)",
    "tst AS (SELECT ticker, feature_set, task, model, avg(coalesce(rmse, balanced_accuracy)) AS selection_fold_mean, "
    "stddev_pop(coalesce(rmse, balanced_accuracy)) AS selection_fold_std, count(*) AS selection_n_folds FROM tboth "
    "WHERE fold >= 0 AND model = 'baseline_persistence' GROUP BY ALL)",
    "cmp AS (SELECT tboth.*, selection_fold_mean, selection_fold_std, selection_n_folds FROM tboth LEFT JOIN tst USING (ticker, feature_set, task, model) WHERE fold = -1)",
)

QUERIES = {
    "selected_ridge_certificate": selected_ridge_certificate,
    "training_baselines": training_baselines,
    "training_run": training_run,
    "training_comparison": training_comparison,
}

ORACLES = {
    "selected_ridge_certificate": query(
        *FULL,
        *REGIONS,
        "cert AS (SELECT ticker, feature_set, fold, count(*) AS n_rows, 20 AS n_columns, true AS solved FROM trained GROUP BY ALL)",
        emit("cert", "ticker feature_set fold:i n_rows:i n_columns:i solved:b"),
    ),
    # A set with a training region brings a linear candidate, persistence and a floor; all of these have the same number of folds.
    "training_run": query(
        *FULL,
        *REGIONS,
        "served AS (SELECT ticker, feature_set, max(c) AS c FROM trained WHERE fold = -1 GROUP BY ALL)",
        "told AS (SELECT ticker, unnest(['regression', 'classification']) AS task, count(*) * 3 AS n_compared, true AS least_cost, true AS columns_fit, "
        "true AS has_metric, min(CASE WHEN c // 5 >= 10 THEN 4 ELSE 0 END) AS n_folds FROM served GROUP BY 1)",
        emit("told", "ticker task n_compared:i least_cost:b columns_fit:b has_metric:b n_folds:i"),
    ),
    "training_baselines": query(
        *FULL,
        *REGIONS,
        *SCORES,
        emit(
            "cmp",
            "ticker feature_set model rmse:f mae:f directional_accuracy:f task accuracy:f balanced_accuracy:f precision:f recall:f f1:f "
            "pct_predicted_up:f selection_fold_mean:f selection_fold_std:f selection_n_folds:i",
        ),
    ),
}
