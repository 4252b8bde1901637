"""Pessimistic model and feature-set selection on fold statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOORS = ["baseline_zero_return", "baseline_majority"]


def selection_cost(task: Column, mean: Column, std: Column) -> Column:
    """Lower is better for both tasks: inconsistency across folds counts against a candidate."""
    return F.when(task == "regression", mean + 0.5 * std).otherwise(-(mean - 0.5 * std))


def holdout_cost(task: Column, metric: Column) -> Column:
    return F.when(task == "regression", metric).otherwise(-metric)


def select_models(candidates: DataFrame, *keys: str) -> DataFrame:
    """The winner per (keys, task) of (task, model, ordinal, metric, fold_mean, fold_std).

    Floors never win. Fold scores decide; only a group without any falls back to the hold-out
    metric. The earlier candidate wins a tie.
    """
    task = F.col("task")
    by_fold = selection_cost(task, F.col("fold_mean"), F.col("fold_std"))
    by_metric = holdout_cost(task, F.col("metric"))
    row = F.struct("model", "ordinal", "metric", "fold_mean", "fold_std")

    def best(cost: Column) -> Column:
        return F.min_by(row, F.when(cost.isNotNull(), F.struct(cost, F.col("ordinal"))))

    eligible = candidates.where(~F.col("model").isin(FLOORS))
    picked = eligible.groupBy(*keys, "task").agg(
        F.count(by_fold).alias("_folded"), best(by_fold).alias("_fold"), best(by_metric).alias("_holdout")
    )
    used = F.col("_folded") > 0
    return picked.select(
        *keys,
        "task",
        F.when(used, F.lit("walk_forward")).otherwise(F.lit("single_holdout_fallback")).alias("selection_basis"),
        F.when(used, F.col("_fold")).otherwise(F.col("_holdout")).alias("_best"),
    ).select(*keys, "task", "selection_basis", "_best.*")


def select_feature_sets(winners: DataFrame, *keys: str) -> DataFrame:
    """One feature set per (keys, task) among the winners of each; earlier set wins a tie."""
    task = F.col("task")
    cost = F.coalesce(
        F.when(
            F.col("selection_basis") == "walk_forward",
            selection_cost(task, F.col("fold_mean"), F.col("fold_std")),
        ),
        holdout_cost(task, F.col("metric")),
    )
    row = F.struct(*[name for name in winners.columns if name not in (*keys, "task")])
    return (
        winners.groupBy(*keys, "task")
        .agg(F.min_by(row, F.struct(cost, F.col("set_ordinal"))).alias("_best"))
        .select(*keys, "task", "_best.*")
    )
