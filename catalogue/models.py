"""Model fits, walk-forward training and scoring."""

from pyspark.sql import functions as F

from catalogue.bars import FEATURE_CTES
from catalogue.common import emit, portable, query
from catalogue.intraday import CTES as INTRADAY_CTES
from catalogue.intraday import DAY_SPLIT
from catalogue.macro import ALIGNED, ENHANCED, MACRO_CTES
from catalogue.news import CARRIED, COVERED, NEWS_CTES, NEWS_SPEC, TICKER_NEWS, TICKERS, scored
from quaymark import config, schemas
from quaymark.models import linear, trees
from quaymark.operators import features, intraday, macro, metrics, news, splits
from quaymark.plans import intraday_training, training
from quaymark.session import settle
from quaymark.sources import derived

TWO = ["ret_1d", "hl_range"]


def own_table(spark, folder):
    return features.own_features(derived.daily_bars(spark, folder))


def full_table(spark, folder):
    """All 53 features of all instruments."""
    block = macro.macro_features(derived.macro_bars(spark, folder))
    coverage = news.ticker_news(news.daily_news(scored(spark, folder)), TICKERS, COVERED)
    return features.feature_table(settle(derived.daily_bars(spark, folder)), block, coverage)


def market_data(spark, folder):
    return features.dataset(features.own_features(derived.market_bars(spark, folder)), schemas.OWN_FEATURES)


def _long_coefficients(fitted, columns, *keys):
    named = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), F.col("coefficients").alias("coefficient"))
    return fitted.select(*keys, "intercept", F.explode(named).alias("_c")).select(*keys, "intercept", "_c.*")


def news_feature_dataset(spark, folder):
    columns = schemas.FEATURE_SETS["with_macro_and_news"]
    return portable(features.dataset(full_table(spark, folder), columns))


def ridge_two_factor(spark, folder):
    data = features.dataset(own_table(spark, folder), TWO)
    fitted = linear.fit_ridge(data, TWO, "target_return", "ticker")
    return portable(_long_coefficients(fitted, TWO, "ticker"))


def walk_forward_two_factor(spark, folder):
    data = features.dataset(own_table(spark, folder), TWO)
    return portable(training.walk_forward(data, TWO, "regression"))


def ridge_returns(spark, folder):
    data = features.dataset(own_table(spark, folder), schemas.OWN_FEATURES)
    fitted = linear.fit_ridge(data, schemas.OWN_FEATURES, "target_return", "ticker")
    return portable(_long_coefficients(fitted, schemas.OWN_FEATURES, "ticker"))


def walk_forward_ridge(spark, folder):
    data = features.dataset(own_table(spark, folder), schemas.OWN_FEATURES)
    return portable(training.walk_forward(data, schemas.OWN_FEATURES, "regression"))


def logistic_direction(spark, folder):
    data = features.dataset(own_table(spark, folder), schemas.OWN_FEATURES)
    marked = settle(splits.chrono_split(data, "ticker"))
    train, test = marked.where("split = 'train'"), marked.where("split = 'test'")
    scored_rows = training.linear_predictions(train, test, schemas.OWN_FEATURES, "classification", "ticker")
    return portable(training.task_metrics(scored_rows, "classification", "ticker"))


def rf_feature_topk(spark, folder):
    """The best columns of every instrument and of the market index, by the library's own probe."""
    bars = settle(derived.all_bars(spark, folder))
    data = features.dataset(features.own_features(bars), schemas.OWN_FEATURES)
    train = settle(splits.chrono_split(data, "ticker").where("split = 'train'"))
    ranked = []
    for (ticker,) in train.select("ticker").distinct().orderBy("ticker").collect():
        model = trees.fit_tree(
            train.where(F.col("ticker") == ticker), schemas.OWN_FEATURES, "forest", "regression", trees.PROBE
        )
        ranking = trees.feature_ranking(model, schemas.OWN_FEATURES, spark)
        ranked.append(ranking.select(F.lit(ticker).alias("ticker"), "*"))
    return portable(linear.stack(ranked).where(F.col("rank") <= config.TOP_FEATURES))


SMALL_TREES = training.TreePlan(
    draws=1,
    tuning_folds=2,
    recency=False,
    grids={
        "forest": {"numTrees": [10], "maxDepth": [3], "minInstancesPerNode": [20], "featureSubsetStrategy": ["sqrt"]},
        "boost": {"maxIter": [5], "maxDepth": [3], "stepSize": [0.1]},
    },
    probe={"numTrees": 10, "maxDepth": 4, "minInstancesPerNode": 5},
)


def soft_vote(spark, folder):
    """Forest, boosting and their vote on the market index, with fold statistics."""
    table, _, _, _ = training.tree_candidates(market_data(spark, folder), schemas.OWN_FEATURES, "classification", SMALL_TREES)
    return portable(table)


def model_comparison(spark, folder):
    """Grouped candidates of all instruments on the own feature set, both tasks."""
    table = settle(own_table(spark, folder))
    return portable(training.train_grouped(table, {"baseline": schemas.OWN_FEATURES}))


TWO_SETS = {"baseline": TWO, "with_macro": [*TWO, "vix_ret_1d", "credit_stress"]}


def _regression_comparison(spark, folder):
    """Regression candidates on two small feature sets."""
    block = macro.macro_features(derived.macro_bars(spark, folder))
    table = settle(features.feature_table(settle(derived.daily_bars(spark, folder)), block))
    parts = [
        training.comparison_rows(
            training.grouped_candidates(features.dataset(table, columns), columns, "regression"), name
        )
        for name, columns in TWO_SETS.items()
    ]
    empty = [c for c in ("accuracy", "balanced_accuracy") if c not in parts[0].columns]
    stacked = linear.stack(parts).withColumns({c: F.lit(None).cast("double") for c in empty})
    return table, settle(stacked)


def model_selection(spark, folder):
    _, comparison = _regression_comparison(spark, folder)
    return portable(training.shipped(training.winners(comparison)))


def model_manifest(spark, folder):
    table, comparison = _regression_comparison(spark, folder)
    kept = settle(training.shipped(training.winners(comparison)))
    models = training.fit_shipped(table, kept, TWO_SETS)
    return portable(models.select("ticker", "task", "model", F.array_join("columns", ",").alias("columns"), "intercept"))


def persistence_models(spark, folder):
    """Shipped models in the store's shape when persistence wins everywhere."""
    tickers = derived.daily_bars(spark, folder).select("ticker").distinct()
    tasks = F.explode(F.array(F.lit("regression"), F.lit("classification"))).alias("task")
    return tickers.select("ticker", tasks).select(
        "*",
        F.lit(training.PERSISTENCE).alias("model"),
        F.array(F.lit("ret_1d")).alias("columns"),
        F.lit(0.0).alias("intercept"),
        F.array(F.lit(1.0)).alias("coefficients"),
    )


def scored_by_manifest(spark, folder):
    frame = training.score_shipped(own_table(spark, folder), persistence_models(spark, folder))
    return portable(frame.select("ticker", "date", "close", "pred_return", "up_probability", "complete"))


def intraday_ridge(spark, folder):
    """Ridge on two snapshot features, all instruments at once."""
    snaps = intraday.snapshots(derived.intraday_bars(spark, folder), derived.event_days(spark, folder))
    marked = splits.day_split(snaps, "ticker", min_days=3)
    pair = ["ret_since_open", "pos_in_range"]
    fitted = linear.fit_ridge(marked.where("split = 'train'"), pair, intraday_training.TARGET, "ticker")
    test = linear.score_linear(marked.where("split = 'test'"), fitted, pair, "prediction", "ticker")
    fitted_only = test.where(F.col("prediction").isNotNull())
    return portable(metrics.regression_metrics(fitted_only, "ticker", actual=intraday_training.TARGET))


def intraday_training_summary(spark, folder):
    table, _ = intraday_training.train_intraday(
        derived.intraday_bars(spark, folder), derived.event_days(spark, folder), min_rows=20, min_days=3
    )
    return portable(table)


def _ridge_sql(source: str, x1: str, x2: str, y: str, keys: str, name: str = "fit") -> str:
    """Closed form of two-feature ridge with penalty 1 on standardised features."""
    return (
        f"{name}_m AS (SELECT {keys}, count(*)::DOUBLE AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, stddev_pop({x1}) AS s1, stddev_pop({x2}) AS s2, "
        f"corr({x1}, {x2}) AS r, covar_pop({x1}, {y}) AS c1, covar_pop({x2}, {y}) AS c2 FROM {source} GROUP BY ALL), "
        f"{name}_w AS (SELECT *, ((n + 1) * n * c1 / s1 - n * r * n * c2 / s2) / ((n + 1) * (n + 1) - n * r * n * r) / s1 AS b1, "
        f"((n + 1) * n * c2 / s2 - n * r * n * c1 / s1) / ((n + 1) * (n + 1) - n * r * n * r) / s2 AS b2 FROM {name}_m), "
        f"{name} AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM {name}_w)"
    )


PAIR_ROWS = "pr AS (SELECT * FROM feat WHERE ret_1d IS NOT NULL AND hl_range IS NOT NULL AND target_return IS NOT NULL)"
PAIR_FOLDS = (
    "pn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS r_, count(*) OVER (PARTITION BY ticker) AS c_ FROM pr), "
    "pf AS (SELECT pn.*, k AS fold, CASE WHEN r_ >= c_ - (4 - k) * (c_ // 5) THEN 'test' ELSE 'train' END AS role "
    "FROM pn, range(4) t(k) WHERE c_ // 5 >= 10 AND r_ < c_ - (3 - k) * (c_ // 5)), "
    "ptrain AS (SELECT * FROM pf WHERE role = 'train')"
)

QUERIES = {
    "news_feature_dataset": news_feature_dataset,
    "ridge_two_factor": ridge_two_factor,
    "walk_forward_two_factor": walk_forward_two_factor,
    "ridge_returns": ridge_returns,
    "walk_forward_ridge": walk_forward_ridge,
    "logistic_direction": logistic_direction,
    "rf_feature_topk": rf_feature_topk,
    "soft_vote": soft_vote,
    "model_comparison": model_comparison,
    "model_selection": model_selection,
    "model_manifest": model_manifest,
    "scored_by_manifest": scored_by_manifest,
    "intraday_ridge": intraday_ridge,
    "intraday_training_summary": intraday_training_summary,
}

WITH_NEWS = (
    "full_ AS (SELECT enh.*, n.* EXCLUDE (ticker, date, close, is_row) FROM enh LEFT JOIN ncarried n "
    "ON n.is_row AND n.ticker = enh.ticker AND n.date = enh.date)"
)

ORACLES = {
    "news_feature_dataset": query(
        *FEATURE_CTES,
        *MACRO_CTES,
        ALIGNED,
        ENHANCED,
        *NEWS_CTES,
        TICKER_NEWS,
        CARRIED,
        WITH_NEWS,
        emit(
            "full_",
            "ticker date:d "
            + " ".join(f"{c}:f" for c in schemas.FEATURE_SETS["with_macro"])
            + f" {NEWS_SPEC} target_return:f target_direction:i close:f",
        )
        + " WHERE target_return IS NOT NULL AND "
        + " AND ".join(f"{c} IS NOT NULL" for c in schemas.FEATURE_SETS["with_macro_and_news"]),
    ),
    "ridge_two_factor": query(
        *FEATURE_CTES,
        PAIR_ROWS,
        _ridge_sql("pr", "ret_1d", "hl_range", "target_return", "ticker"),
        "o AS (SELECT ticker, b0 AS intercept, 'ret_1d' AS feature, b1 AS coefficient FROM fit UNION ALL SELECT ticker, b0, 'hl_range', b2 FROM fit)",
        emit("o", "ticker intercept:f feature coefficient:f"),
    ),
    "walk_forward_two_factor": query(
        *FEATURE_CTES,
        PAIR_ROWS,
        PAIR_FOLDS,
        _ridge_sql("ptrain", "ret_1d", "hl_range", "target_return", "ticker, fold"),
        "fs AS (SELECT pf.ticker, pf.fold, sqrt(avg((b0 + b1 * ret_1d + b2 * hl_range - target_return) ** 2)) AS score FROM pf JOIN fit "
        "ON fit.ticker = pf.ticker AND fit.fold = pf.fold WHERE role = 'test' GROUP BY ALL)",
        "st AS (SELECT ticker, 'regression' AS task, 'linear_ridge' AS model, avg(score) AS walk_forward_mean, stddev_pop(score) AS walk_forward_std, count(*) AS n_folds FROM fs GROUP BY 1)",
        emit("st", "ticker task model walk_forward_mean:f walk_forward_std:f n_folds:i"),
    ),
    "scored_by_manifest": query(
        *FEATURE_CTES,
        "s AS (SELECT ticker, date, close, ret_1d AS pred_return, CASE WHEN ret_1d IS NULL THEN NULL WHEN ret_1d > 0 THEN 0.98 ELSE 0.02 END AS up_probability, ret_1d IS NOT NULL AS complete FROM feat)",
        emit("s", "ticker date:d close:f pred_return:f up_probability:f complete:b"),
    ),
    "intraday_ridge": query(
        *INTRADAY_CTES,
        DAY_SPLIT.replace("// 100, 10)", "// 100, 3)"),
        "itrain AS (SELECT * FROM sp WHERE split = 'train')",
        _ridge_sql("itrain", "ret_since_open", "pos_in_range", "target_return_to_close", "ticker"),
        "sc AS (SELECT sp.ticker, target_return_to_close AS y, b0 + b1 * ret_since_open + b2 * pos_in_range AS p FROM sp JOIN fit ON fit.ticker = sp.ticker WHERE split = 'test')",
        "m AS (SELECT ticker, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, avg(CASE WHEN sign(p) = sign(y) THEN 1.0::DOUBLE ELSE 0 END) AS directional_accuracy FROM sc GROUP BY 1)",
        emit("m", "ticker rmse:f mae:f directional_accuracy:f"),
    ),
}
