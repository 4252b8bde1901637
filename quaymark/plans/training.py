"""Training: candidates per instrument, feature set and task, walk-forward selection, manifest.

Linear candidates, baselines and floors of all instruments are fitted and scored together. Tree
candidates are one MLlib job each; the driver loops over instruments and candidates only.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.functions import weights
from quaymark.models import linear, trees
from quaymark.operators import baselines, features, metrics, selection, splits
from quaymark.session import settle

TASKS = ("regression", "classification")
LABELS = trees.LABELS
LINEAR = {"regression": "linear_ridge", "classification": "logistic_regression"}
FLOOR = {"regression": "baseline_zero_return", "classification": "baseline_majority"}
PERSISTENCE = "baseline_persistence"
HOLDOUT = -1
COEFFICIENTS = "ticker string, task string, model string, columns array<string>, intercept double, coefficients array<double>"
# Order of the candidates inside one task; it settles ties.
ORDER = [
    "baseline_zero_return", "baseline_majority", "linear_ridge", "logistic_regression",
    "random_forest_tuned", "hist_gradient_boosting_tuned", "voting_ensemble",
    "random_forest_recency_weighted", "hist_gradient_boosting_recency_weighted", PERSISTENCE,
]


@dataclass(frozen=True)
class TreePlan:
    """How much tree search to run; smaller plans keep trials short."""

    draws: int = config.SEARCH_DRAWS
    tuning_folds: int = config.TUNING_FOLDS
    recency: bool = True
    workers: int = 4
    grids: dict = field(default_factory=lambda: dict(trees.GRIDS))
    probe: dict | None = None


def task_metrics(scored: DataFrame, task: str, *keys: str) -> DataFrame:
    """Metrics of ``prediction``: a return, or the probability of an up day."""
    if task == "regression":
        return metrics.regression_metrics(scored, *keys)
    called = scored.withColumn("called_up", (F.col("prediction") > config.UP_THRESHOLD).cast("int"))
    return metrics.classification_metrics(called, *keys)


def main_metric(task: str) -> str:
    return "rmse" if task == "regression" else "balanced_accuracy"


def linear_predictions(train: DataFrame, test: DataFrame, columns: list[str], task: str, *keys: str) -> DataFrame:
    """``test`` with the prediction of the linear candidate fitted on ``train``, per group of ``keys``."""
    if task == "regression":
        fitted = linear.fit_ridge(train, columns, LABELS[task], *keys)
        return linear.score_linear(test, fitted, columns, "prediction", *keys)
    weighted = train.withColumn("_cw", weights.balanced_class(LABELS[task], *keys))
    fitted = linear.fit_logistic(weighted, columns, LABELS[task], *keys, weight="_cw")
    scored = linear.score_linear(test, fitted, columns, "prediction", *keys)
    return scored.withColumn("prediction", linear.probability(F.col("prediction")))


def baseline_predictions(train: DataFrame, test: DataFrame, task: str, *keys: str) -> DataFrame:
    """Persistence and the know-nothing floor, in long form with ``model``."""
    persistence = (
        baselines.persistence_return() if task == "regression" else baselines.persistence_probability()
    )
    if task == "regression":
        floor = test.withColumn("prediction", baselines.zero_return())
    else:
        majority = baselines.majority_class(train, *keys)
        floor = test.join(majority, list(keys)).withColumn("prediction", F.col("majority").cast("double")).drop("majority")
    return (
        test.withColumn("prediction", persistence)
        .withColumn("model", F.lit(PERSISTENCE))
        .unionByName(floor.withColumn("model", F.lit(FLOOR[task])))
    )


def grouped_predictions(train: DataFrame, test: DataFrame, columns: list[str], task: str, *keys: str) -> DataFrame:
    by_line = linear_predictions(train, test, columns, task, *keys).withColumn("model", F.lit(LINEAR[task]))
    narrow = [*keys, "date", LABELS[task], "prediction", "model"]
    return by_line.select(narrow).unionByName(baseline_predictions(train, test, task, *keys).select(narrow))


def holdout_and_folds(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fit rows, test rows) of the hold-out split (fold -1) and of the folds of its training region.

    One frame for both, so that every model family is fitted for all of them at once.
    """
    marked = splits.chrono_split(data, "ticker")
    holdout = marked.withColumnRenamed("split", "role").withColumn("fold", F.lit(HOLDOUT))
    folds = splits.expanding_folds(marked.where("split = 'train'").drop("split"), "ticker")
    rows = settle(holdout.unionByName(folds))
    return rows.where("role = 'train'").drop("role"), rows.where("role = 'test'").drop("role")


def grouped_candidates(data: DataFrame, columns: list[str], task: str) -> DataFrame:
    """Hold-out metrics and fold statistics of the grouped candidates of every instrument."""
    fit_rows, test = holdout_and_folds(data)
    predictions = grouped_predictions(fit_rows, test, columns, task, "ticker", "fold")
    scores = settle(task_metrics(predictions, task, "ticker", "model", "fold"))
    return with_fold_statistics(
        scores.where(F.col("fold") == HOLDOUT).drop("fold"), scores.where(F.col("fold") > HOLDOUT), task
    )


def with_fold_statistics(holdout: DataFrame, fold_scores: DataFrame, task: str) -> DataFrame:
    stats = metrics.fold_statistics(
        fold_scores.where(~F.col("model").isin(selection.FLOORS)), "ticker", "model", score=main_metric(task)
    )
    return holdout.join(stats, ["ticker", "model"], "left").withColumn("task", F.lit(task))


def _tree_candidate(train, columns, task, name, kind, plan):
    """Search and fit one tree candidate of one instrument."""
    recency = name.endswith("recency_weighted")
    params = trees.search(train, columns, kind, task, plan.draws, plan.tuning_folds, recency, plan.grids[kind])
    return name, kind, params, recency, trees.fit_weighted(train, columns, kind, task, params, recency)


def _with_recency(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_recency", weights.recency_by_rows("ticker"))


def _with_linear(fit_rows: DataFrame, score_rows: DataFrame, columns: list[str], task: str) -> DataFrame:
    scored = linear_predictions(fit_rows, score_rows, columns, task, "ticker")
    return scored.withColumnRenamed("prediction", "_linear")


def _tree_predictions(wide: DataFrame, fitted: dict, task: str, keep: list[str]) -> DataFrame:
    """Long predictions of the fitted trees and of the vote with the linear member in ``_linear``."""
    for name, model in fitted.items():
        wide = trees.score_tree(wide, model, task, f"_{name}")
    values = {name: F.col(f"_{name}") for name in fitted}
    if {"random_forest_tuned", "hist_gradient_boosting_tuned"} <= set(fitted):
        values["voting_ensemble"] = (
            F.col("_linear") + F.col("_random_forest_tuned") + F.col("_hist_gradient_boosting_tuned")
        ) / 3
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), v.alias("prediction")) for n, v in values.items()])
    fixed = ["ticker", "date", LABELS[task], *keep]
    return wide.select(*fixed, F.explode(pairs).alias("_p")).select(*fixed, "_p.*")


def tree_fold_scores(
    rows: DataFrame, columns: list[str], task: str, specs: dict, workers: int = 4
) -> DataFrame | None:
    """Metrics of the trees and their vote on every expanding fold of one instrument's rows.

    Each fold refits with the given settings, recency counted from the fold's own end.
    """
    folded = settle(splits.expanding_folds(rows, "ticker"))

    def one_fold(fold: int) -> DataFrame:
        part = folded.where(F.col("fold") == fold)
        fit_rows = settle(_with_recency(part.where("role = 'train'")))
        refitted = {
            name: trees.fit_weighted(fit_rows, columns, kind, task, params, recency)
            for name, (kind, params, recency) in specs.items()
        }
        wide = _with_linear(fit_rows, part.where("role = 'test'"), columns, task)
        return _tree_predictions(wide, refitted, task, ["fold"])

    folds = [row["fold"] for row in folded.select("fold").distinct().orderBy("fold").collect()]
    if not folds:
        return None
    with ThreadPoolExecutor(workers) as pool:
        return task_metrics(linear.stack(list(pool.map(one_fold, folds))), task, "ticker", "model", "fold")


def tree_candidates(data: DataFrame, columns: list[str], task: str, plan: TreePlan = TreePlan()):
    """Tree and voting candidates of the one instrument in ``data``: (metrics with folds, models, columns, settings).

    Class balance and recency weights multiply; the vote's members carry no recency weights. Folds
    refit everything on rows of the training region only, with recency counted from the fold's end.
    """
    marked = settle(splits.chrono_split(data, "ticker"))
    train = settle(_with_recency(marked.where("split = 'train'").drop("split")))
    test = marked.where("split = 'test'").drop("split")
    chosen = trees.top_features(train, columns, task, params=plan.probe)

    wanted = [("random_forest_tuned", "forest"), ("hist_gradient_boosting_tuned", "boost")]
    if plan.recency:
        wanted += [("random_forest_recency_weighted", "forest"), ("hist_gradient_boosting_recency_weighted", "boost")]
    with ThreadPoolExecutor(plan.workers) as pool:
        found = list(pool.map(lambda item: _tree_candidate(train, chosen, task, *item, plan), wanted))

    models = {name: model for name, _, _, _, model in found}
    wide = _with_linear(train, test, chosen, task)
    holdout = task_metrics(_tree_predictions(wide, models, task, []), task, "ticker", "model")

    specs = {name: (kind, params, recency) for name, kind, params, recency, _ in found}
    fold_scores = tree_fold_scores(train.drop("_recency"), chosen, task, specs, plan.workers)
    if fold_scores is None:
        nothing = F.lit(None).cast("double")
        empty = holdout.withColumns({"fold_mean": nothing, "fold_std": nothing, "n_folds": F.lit(0).cast("long")})
        return empty.withColumn("task", F.lit(task)), models, chosen, specs
    return with_fold_statistics(holdout, fold_scores, task), models, chosen, specs


def comparison_rows(candidates: DataFrame, feature_set: str) -> DataFrame:
    """Rows of the model comparison report."""
    renamed = candidates.withColumnsRenamed(
        {"fold_mean": "selection_fold_mean", "fold_std": "selection_fold_std", "n_folds": "selection_n_folds"}
    )
    return renamed.withColumn("feature_set", F.lit(feature_set))


def winners(comparison: DataFrame) -> DataFrame:
    """The winning model of every (ticker, feature set, task)."""
    order = F.create_map(*[part for i, name in enumerate(ORDER) for part in (F.lit(name), F.lit(i))])
    rows = comparison.select(
        "ticker",
        "feature_set",
        "task",
        "model",
        order[F.col("model")].alias("ordinal"),
        F.when(F.col("task") == "regression", F.col("rmse")).otherwise(F.col("balanced_accuracy")).alias("metric"),
        F.col("selection_fold_mean").alias("fold_mean"),
        F.col("selection_fold_std").alias("fold_std"),
    )
    return selection.select_models(rows, "ticker", "feature_set")


def shipped(won: DataFrame) -> DataFrame:
    """The feature set each (ticker, task) keeps."""
    sets = list(schemas.FEATURE_SETS)
    position = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("feature_set"))
    return selection.select_feature_sets(won.withColumn("set_ordinal", position), "ticker")


def train_grouped(feature_table: DataFrame, sets: dict[str, list[str]] = schemas.FEATURE_SETS) -> DataFrame:
    """The model comparison of all instruments for the grouped candidates, all sets and tasks."""
    parts = []
    for name, columns in sets.items():
        data = features.dataset(feature_table, columns)
        for task in TASKS:
            parts.append(comparison_rows(grouped_candidates(data, columns, task), name))
    return linear.stack(parts)


def fit_shipped(feature_table: DataFrame, kept: DataFrame, sets: dict[str, list[str]] = schemas.FEATURE_SETS) -> DataFrame:
    """Coefficients and manifest of the kept models, fitted on the training region only.

    (ticker, task, model, columns, intercept, coefficients); persistence reads ret_1d as it is.
    """
    parts = []
    for task in TASKS:
        for name, columns in sets.items():
            here = kept.where((F.col("task") == task) & (F.col("feature_set") == name)).select("ticker", "model")
            if here.isEmpty():
                continue
            train = splits.chrono_split(features.dataset(feature_table, columns), "ticker").where("split = 'train'")
            train = train.join(here.where(F.col("model") == LINEAR[task]), "ticker", "left_semi")
            if task == "regression":
                fitted = linear.fit_ridge(train, columns, LABELS[task], "ticker").drop("n")
            else:
                train = train.withColumn("_cw", weights.balanced_class(LABELS[task], "ticker"))
                fitted = linear.fit_logistic(train, columns, LABELS[task], "ticker", weight="_cw")
            parts.append(
                fitted.join(here, "ticker").select(
                    "ticker",
                    F.lit(task).alias("task"),
                    "model",
                    F.array(*[F.lit(c) for c in columns]).alias("columns"),
                    "intercept",
                    "coefficients",
                )
            )
            parts.append(
                here.where(F.col("model") == PERSISTENCE).select(
                    "ticker",
                    F.lit(task).alias("task"),
                    "model",
                    F.array(F.lit("ret_1d")).alias("columns"),
                    F.lit(0.0).alias("intercept"),
                    F.array(F.lit(1.0)).alias("coefficients"),
                )
            )
    if not parts:
        return feature_table.sparkSession.createDataFrame([], COEFFICIENTS)
    return linear.stack(parts)


def walk_forward(data: DataFrame, columns: list[str], task: str) -> DataFrame:
    """Full-history stability of the linear candidate: (ticker, task, model, mean, std, n_folds)."""
    folded = settle(splits.expanding_folds(data, "ticker"))
    fit_rows, test = folded.where("role = 'train'").drop("role"), folded.where("role = 'test'").drop("role")
    scored = linear_predictions(fit_rows, test, columns, task, "ticker", "fold")
    scores = task_metrics(scored, task, "ticker", "fold")
    stats = metrics.fold_statistics(scores, "ticker", score=main_metric(task))
    return stats.select(
        "ticker",
        F.lit(task).alias("task"),
        F.lit(LINEAR[task]).alias("model"),
        F.col("fold_mean").alias("walk_forward_mean"),
        F.col("fold_std").alias("walk_forward_std"),
        "n_folds",
    )


def stability_report(data_by_set: dict[str, DataFrame], kept: DataFrame, sets: dict[str, list[str]] = schemas.FEATURE_SETS) -> DataFrame:
    """Stability rows of the kept models with their single-window metric."""
    parts = []
    for task in TASKS:
        for name, columns in sets.items():
            here = kept.where((F.col("task") == task) & (F.col("feature_set") == name))
            data = data_by_set[name]
            by_line = walk_forward(data, columns, task)
            test = splits.expanding_folds(data, "ticker").where("role = 'test'")
            value = baselines.persistence_return() if task == "regression" else baselines.persistence_probability()
            scores = task_metrics(test.withColumn("prediction", value), task, "ticker", "fold")
            naive = metrics.fold_statistics(scores, "ticker", score=main_metric(task)).select(
                "ticker",
                F.lit(task).alias("task"),
                F.lit(PERSISTENCE).alias("model"),
                F.col("fold_mean").alias("walk_forward_mean"),
                F.col("fold_std").alias("walk_forward_std"),
                "n_folds",
            )
            parts.append(
                here.select("ticker", "task", "model", F.col("metric").alias("single_window_metric")).join(
                    by_line.unionByName(naive), ["ticker", "task", "model"]
                )
            )
    return linear.stack(parts)


def ticker_summary(won: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per instrument: every set's winning metric and what was kept."""

    def metric(feature_set: str, task: str):
        here = (F.col("feature_set") == feature_set) & (F.col("task") == task)
        return F.max(F.when(here, F.col("metric")))

    prefixes = {"baseline": "baseline", "with_macro": "with_macro", "with_macro_and_news": "with_news"}
    metric_columns = [metric(s, "regression").alias(f"{p}_reg_rmse") for s, p in prefixes.items()] + [
        metric(s, "classification").alias(f"{p}_clf_balanced_acc") for s, p in prefixes.items()
    ]

    def label(task: str):
        text = F.concat_ws(" / ", "feature_set", "model")
        return F.max(F.when(F.col("task") == task, text))

    names = kept.groupBy("ticker").agg(
        label("regression").alias("regressor_kept"), label("classification").alias("classifier_kept")
    )
    return won.groupBy("ticker").agg(*metric_columns).join(names, "ticker")


def score_shipped(feature_table: DataFrame, models: DataFrame) -> DataFrame:
    """Every day with the shipped models' return and up-probability, and whether its row was complete."""
    everything = schemas.FEATURE_SETS["with_macro_and_news"]
    known = [c for c in everything if c in feature_table.columns]
    frame = feature_table
    for task, output in (("regression", "pred_return"), ("classification", "_score")):
        frame = linear.score_by_manifest(frame, models.where(F.col("task") == task), output, known)
    model = models.where("task = 'classification'").select("ticker", F.col("model").alias("_clf"))
    frame = frame.join(model, "ticker", "left")
    naive = F.when(F.col("_score").isNotNull(), baselines.persistence_probability())
    probability = F.when(F.col("_clf") == PERSISTENCE, naive).otherwise(linear.probability(F.col("_score")))
    complete = F.col("pred_return").isNotNull() & F.col("_score").isNotNull()
    return frame.withColumns({"up_probability": probability, "complete": complete}).drop("_score", "_clf")
