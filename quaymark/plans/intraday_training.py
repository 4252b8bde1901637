"""Intraday training: predict the rest of the day from session-to-date snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.models import linear, trees
from quaymark.operators import intraday, metrics, splits
from quaymark.session import settle

TARGET = "target_return_to_close"
# Settings of the two tree candidates.
FOREST = {"numTrees": 300, "maxDepth": 6, "minInstancesPerNode": 10}
BOOST = {"maxDepth": 4, "stepSize": 0.05, "maxIter": 300}


def enough(snapshots: DataFrame, min_rows: int = config.MIN_INTRADAY_ROWS) -> DataFrame:
    """Snapshots of instruments with at least ``min_rows`` of them."""
    sizes = snapshots.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return snapshots.join(sizes.select("ticker"), "ticker", "left_semi")


def grouped_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Ridge and the zero floor for all instruments, in long form with ``model``."""
    columns = schemas.SNAPSHOT_FEATURES
    fitted = linear.fit_ridge(train, columns, TARGET, "ticker")
    ridge = linear.score_linear(test, fitted, columns, "prediction", "ticker").withColumn("model", F.lit("linear_ridge"))
    return ridge.unionByName(
        test.withColumns({"prediction": F.lit(0.0), "model": F.lit("baseline_zero_return")})
    )


def tree_predictions(train: DataFrame, test: DataFrame, forest: dict = FOREST, boost: dict = BOOST):
    """Forest and boosting of the one instrument in ``train``: (long predictions, models)."""
    frames, models = [], {}
    for name, kind, params in (("random_forest", "forest", forest), ("hist_gradient_boosting", "boost", boost)):
        models[name] = trees.fit_tree(train, schemas.SNAPSHOT_FEATURES, kind, "regression", params, label=TARGET)
        scored = trees.score_tree(test, models[name], "regression")
        frames.append(scored.withColumn("model", F.lit(name)))
    return linear.stack(frames), models


def summarise(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics per model, time-bucket accuracy of each instrument's best model).

    The best model has the lowest test RMSE; the floor cannot win.
    """
    table = metrics.regression_metrics(predictions, "ticker", "model", actual=TARGET)
    best = (
        table.where(F.col("model") != "baseline_zero_return")
        .groupBy("ticker")
        .agg(F.min_by("model", F.struct("rmse", "model")).alias("model"))
    )
    winning = predictions.join(best, ["ticker", "model"])
    return table, intraday.accuracy_by_time(winning, "ticker", "model")


def train_intraday(
    bars: DataFrame,
    daily: DataFrame,
    min_rows: int = config.MIN_INTRADAY_ROWS,
    min_days: int = config.MIN_TEST_DAYS,
):
    """(metrics, bucket table) of the grouped candidates of all instruments."""
    usable = enough(intraday.snapshots(bars, daily), min_rows)
    snapshots = settle(splits.day_split(usable, "ticker", min_days=min_days))
    train, test = snapshots.where("split = 'train'").drop("split"), snapshots.where("split = 'test'").drop("split")
    return summarise(settle(grouped_predictions(train, test)))


def fit_intraday(snapshots: DataFrame) -> DataFrame:
    """Coefficients of the intraday ridge per instrument, from the training days only."""
    train = splits.day_split(snapshots, "ticker").where("split = 'train'")
    return linear.fit_ridge(train, schemas.SNAPSHOT_FEATURES, TARGET, "ticker")
