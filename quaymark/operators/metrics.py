"""Evaluation metrics as single aggregations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_sign(prediction: Column, actual: Column) -> Column:
    return (F.signum(prediction) == F.signum(actual)).cast("double")


def regression_metrics(
    rows: DataFrame, *keys: str, prediction: str = "prediction", actual: str = "target_return"
) -> DataFrame:
    error = F.col(prediction) - F.col(actual)
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(same_sign(F.col(prediction), F.col(actual))).alias("directional_accuracy"),
    )


def classification_metrics(
    rows: DataFrame, *keys: str, called_up: str = "called_up", actual: str = "target_direction"
) -> DataFrame:
    """Accuracy, balanced accuracy over the classes present, precision, recall, F1, share called up."""
    up, truth = F.col(called_up) == 1, F.col(actual) == 1

    def total(condition: Column) -> Column:
        return F.sum(condition.cast("double"))

    counts = rows.groupBy(*keys).agg(
        total(up & truth).alias("_tp"),
        total(up & ~truth).alias("_fp"),
        total(~up & truth).alias("_fn"),
        total(~up & ~truth).alias("_tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("_tp", "_fp", "_fn", "_tn"))
    everything = tp + fp + fn + tn
    hit_up, hit_down = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    classes = hit_up.isNotNull().cast("int") + hit_down.isNotNull().cast("int")
    zero = F.lit(0.0)
    return counts.select(
        *keys,
        ((tp + tn) / everything).alias("accuracy"),
        ((F.coalesce(hit_up, zero) + F.coalesce(hit_down, zero)) / classes).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(hit_up, zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        ((tp + fp) / everything).alias("pct_predicted_up"),
    )


def fold_statistics(fold_scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    return fold_scores.groupBy(*keys).agg(
        F.avg(score).alias("fold_mean"),
        F.stddev_pop(score).alias("fold_std"),
        F.count(score).alias("n_folds"),
    )
