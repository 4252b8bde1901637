"""Tree candidates on MLlib: random forests, boosted trees, the feature probe and the search."""

import random
from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark import config
from quaymark.functions import weights
from quaymark.operators import metrics, splits

LEARNERS = {
    ("forest", "regression"): RandomForestRegressor,
    ("forest", "classification"): RandomForestClassifier,
    ("boost", "regression"): GBTRegressor,
    ("boost", "classification"): GBTClassifier,
}
GRIDS = {"forest": config.FOREST_GRID, "boost": config.BOOST_GRID}
PROBE = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 5}
LABELS = {"regression": "target_return", "classification": "target_direction"}


def learner(kind: str, task: str, params: dict, label: str | None = None, weight: str | None = None):
    options = dict(params, featuresCol="_features", labelCol=label or LABELS[task], seed=config.RANDOM_SEED)
    if weight:
        options["weightCol"] = weight
    return LEARNERS[kind, task](**options)


def with_weight(train: DataFrame, task: str, recency: bool) -> tuple[DataFrame, str | None]:
    """Rows with ``_weight``: class balance of exactly these rows times their ``_recency``, if asked."""
    balance = weights.balanced_class("target_direction", "ticker") if task == "classification" else F.lit(1.0)
    if task == "regression" and not recency:
        return train, None
    return train.withColumn("_weight", balance * F.col("_recency") if recency else balance), "_weight"


def fit_weighted(
    train: DataFrame, columns: list[str], kind: str, task: str, params: dict, recency: bool
) -> PipelineModel:
    rows, weight = with_weight(train, task, recency)
    return fit_tree(rows, columns, kind, task, params, weight=weight)


def fit_tree(
    train: DataFrame, columns: list[str], kind: str, task: str, params: dict,
    label: str | None = None, weight: str | None = None,
) -> PipelineModel:
    assemble = VectorAssembler(inputCols=columns, outputCol="_features")
    return Pipeline(stages=[assemble, learner(kind, task, params, label, weight)]).fit(train)


def score_tree(rows: DataFrame, model: PipelineModel, task: str, output: str = "prediction") -> DataFrame:
    """Add the predicted return, or the probability of an up day, as ``output``."""
    scored = model.transform(rows)
    value = F.col("prediction") if task == "regression" else vector_to_array("probability")[1]
    extra = [c for c in scored.columns if c not in rows.columns]
    return scored.withColumn("_value", value).drop(*extra).withColumnRenamed("_value", output)


def draws(kind: str, count: int, seed: int = config.RANDOM_SEED, grid: dict | None = None) -> list[dict]:
    """``count`` different parameter choices, the same for the same seed."""
    grid = grid or GRIDS[kind]
    rng, seen = random.Random(seed), []
    total = 1
    for values in grid.values():
        total *= len(values)
    while len(seen) < min(count, total):
        choice = {name: rng.choice(values) for name, values in grid.items()}
        if choice not in seen:
            seen.append(choice)
    return seen


def task_cost(scored: DataFrame, task: str, value: str = "prediction") -> float:
    """RMSE, or minus the balanced accuracy at the decision threshold."""
    if task == "regression":
        return metrics.regression_metrics(scored, prediction=value).first()["rmse"]
    called = scored.withColumn("called_up", (F.col(value) > config.UP_THRESHOLD).cast("int"))
    return -metrics.classification_metrics(called).first()["balanced_accuracy"]


def fold_costs(
    rows: DataFrame, columns: list[str], kind: str, task: str, params: dict, folds: int, recency: bool = False
) -> list[float]:
    """Refit on every expanding fold of one instrument's rows and score its test block."""
    marked = splits.expanding_folds(rows, "ticker", folds=folds, min_rows=1).persist()
    costs = []
    try:
        for (fold,) in sorted(marked.select("fold").distinct().collect()):
            part = marked.where(F.col("fold") == fold)
            model = fit_weighted(part.where("role = 'train'"), columns, kind, task, params, recency)
            costs.append(task_cost(score_tree(part.where("role = 'test'"), model, task), task))
    finally:
        marked.unpersist()
    if not costs:
        raise ValueError(f"too few rows to tune on {folds} folds")
    return costs


def search(
    rows: DataFrame, columns: list[str], kind: str, task: str, count: int = config.SEARCH_DRAWS,
    folds: int = config.TUNING_FOLDS, recency: bool = False, grid: dict | None = None,
) -> dict:
    """The drawn parameters with the lowest mean fold cost; the earlier draw wins a tie."""
    tried = []
    for choice in draws(kind, count, grid=grid):
        costs = fold_costs(rows, columns, kind, task, choice, folds, recency)
        tried.append((sum(costs) / len(costs), len(tried), choice))
    return min(tried)[2]


def feature_ranking(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    """(feature, importance, rank) of a fitted forest; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(columns, values.tolist()), key=lambda pair: (-pair[1], pair[0]))
    rows = [(name, value, position) for position, (name, value) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def top_features(
    train: DataFrame, columns: list[str], task: str, top: int = config.TOP_FEATURES,
    params: dict | None = None,
) -> list[str]:
    """The ``top`` columns by forest importance; all columns when there are no more than that."""
    if len(columns) <= top:
        return list(columns)
    model = fit_tree(train, columns, "forest", task, params or PROBE)
    ranking = feature_ranking(model, columns, train.sparkSession)
    return [row["feature"] for row in ranking.where(F.col("rank") <= top).orderBy("rank").collect()]


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def load_models(names: Iterable[str], folder: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{folder.rstrip('/')}/{name}") for name in names}
