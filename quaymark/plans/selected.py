"""Training on chosen columns: every instrument, feature set, task and fold in the same jobs.

The probe picks up to 20 columns for every (instrument, set, task) on its training region; ridge and logistic models use
those in comparison, manifest and scoring. Persistence and the floors read all rows as they are. Nothing here loops over
instruments or sets on the driver.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.functions import weights
from quaymark.models import blocks, linear, probe
from quaymark.operators import baselines, metrics
from quaymark.plans import training
from quaymark.session import settle

REGION = ["ticker", "feature_set", "fold"]
FOLDS = config.STABILITY_FOLDS


def _listed(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def choose(served: DataFrame, sets: dict[str, list[str]], top: int = config.TOP_FEATURES, trees: int = probe.TREES) -> DataFrame:
    """(ticker, feature_set, task, places): sets of at most ``top`` columns keep them all, others are probed.

    ``served`` are the rows of :func:`blocks.by_set`; the probe sees their training region only.
    """
    names = blocks.all_columns(sets)
    places = {s: [names.index(c) for c in own] for s, own in sets.items()}
    known = F.create_map(*[part for s, p in places.items() for part in (F.lit(s), F.array(*[F.lit(k) for k in p]))])
    train = served.where(F.col("block") <= FOLDS)
    tasks = F.explode(
        F.array(
            F.struct(F.lit("regression").alias("task"), F.col("target_return").alias("y")),
            F.struct(F.lit("classification").alias("task"), F.col("target_direction").cast("double").alias("y")),
        )
    ).alias("_t")
    keys = ["ticker", "feature_set", "task"]
    large = [s for s, own in sets.items() if len(own) > top]
    rows = train.where(F.col("feature_set").isin(large)).select(
        "ticker", "feature_set", "date", probe.at_places(F.col("x"), known[F.col("feature_set")]).alias("x"), tasks
    )
    rows = rows.select(*keys[:2], "date", "x", "_t.*")
    found = probe.best_places(probe.importances(rows, *keys, trees=trees), *keys, top=top)
    own = known[F.col("feature_set")]
    chosen = found.select(*keys, probe.at_places(own, F.col("places")).alias("places"))
    small = train.where(~F.col("feature_set").isin(large)).select("ticker", "feature_set").distinct()
    both = F.explode(_listed(list(training.TASKS))).alias("task")
    return chosen.unionByName(small.select("ticker", "feature_set", both).withColumn("places", own))


def _slots(rows: DataFrame, top: int) -> DataFrame:
    """The chosen columns as ``c0, c1, ...``; places beyond a shorter choice are 0."""
    return rows.withColumns({f"c{i}": F.coalesce(F.get("x", F.get("places", F.lit(i))), F.lit(0.0)) for i in range(top)})


def fit_markings(
    markings: dict[str, tuple[DataFrame, DataFrame]], chosen: DataFrame, sets: dict[str, list[str]], top: int = config.TOP_FEATURES
) -> DataFrame:
    """(marking, ticker, feature_set, fold, task, places, intercept, coefficients) of both linear candidates.

    ``markings`` has the rows of :func:`blocks.marked` and of :func:`blocks.by_set` by name. The logistic models of all
    markings take their Newton steps together, so a further marking adds rows to a step, but no steps.
    """
    of = {t: chosen.where(F.col("task") == t).drop("task") for t in training.TASKS}
    ridges, trains = [], []
    for name, (rows, served) in markings.items():
        sums = blocks.training_moments(rows, sets).join(of["regression"], ["ticker", "feature_set"])
        ridge = blocks.solve_ridge(sums, len(blocks.all_columns(sets))).drop("n")
        ridges.append(ridge.withColumns({"task": F.lit("regression"), "marking": F.lit(name)}))
        trains.append(
            _slots(blocks.training_rows(served).join(of["classification"], ["ticker", "feature_set"]), top)
            .withColumn("_cw", weights.balanced_class("target_direction", *REGION))
            .select(F.lit(name).alias("marking"), *REGION, "target_direction", "_cw", *[f"c{i}" for i in range(top)])
        )
    train = settle(linear.stack(trains))
    keys = ["marking", *REGION]
    logistic = linear.fit_logistic(train, [f"c{i}" for i in range(top)], "target_direction", *keys, weight="_cw")
    logistic = logistic.join(of["classification"], ["ticker", "feature_set"]).select(
        *keys, "places", "intercept", F.slice("coefficients", F.lit(1), F.size("places")).alias("coefficients"),
        F.lit("classification").alias("task"),
    )
    return linear.stack([*ridges, logistic])


def fit_regions(rows: DataFrame, served: DataFrame, chosen: DataFrame, sets: dict[str, list[str]], top: int = config.TOP_FEATURES) -> DataFrame:
    """(ticker, feature_set, fold, task, places, intercept, coefficients) of both linear candidates."""
    return fit_markings({"rows": (rows, served)}, chosen, sets, top).drop("marking")


def predictions(served: DataFrame, fitted: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(ticker, feature_set, fold, date, targets, task, model, prediction) of every tested row and candidate."""
    names = blocks.all_columns(sets)
    tested = served.where("fold IS NOT NULL")
    scored = tested.join(fitted, REGION).withColumn("_v", linear.linear_value(probe.at_places(F.col("x"), F.col("places"))))
    is_return = F.col("task") == "regression"
    model = F.when(is_return, training.LINEAR["regression"]).otherwise(training.LINEAR["classification"])
    narrow = [*REGION, "date", "target_return", "target_direction"]
    by_line = scored.select(
        *narrow, "task", model.alias("model"), F.when(is_return, F.col("_v")).otherwise(linear.probability(F.col("_v"))).alias("prediction")
    )
    plain = tested.withColumn("ret_1d", F.get("x", F.lit(names.index("ret_1d"))))
    majority = baselines.majority_class(blocks.training_rows(served), *REGION)
    plain = plain.join(majority, REGION)

    def one(task: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(task).alias("task"), F.lit(name).alias("model"), value.cast("double").alias("prediction"))

    simple = F.array(
        one("regression", training.PERSISTENCE, baselines.persistence_return()),
        one("regression", training.FLOOR["regression"], baselines.zero_return()),
        one("classification", training.PERSISTENCE, baselines.persistence_probability()),
        one("classification", training.FLOOR["classification"], F.col("majority")),
    )
    return by_line.unionByName(plain.select(*narrow, F.explode(simple).alias("_p")).select(*narrow, "_p.*"))


def region_metrics(scored: DataFrame) -> DataFrame:
    """Both tasks' metrics of every (ticker, feature_set, task, model, fold)."""
    keys = ("ticker", "feature_set", "model", "fold")
    parts = [
        training.task_metrics(scored.where(F.col("task") == task), task, *keys).withColumn("task", F.lit(task))
        for task in training.TASKS
    ]
    return linear.stack(parts)


def _main() -> Column:
    return F.when(F.col("task") == "regression", F.col("rmse")).otherwise(F.col("balanced_accuracy"))


def comparison(scores: DataFrame) -> DataFrame:
    """Rows of the model comparison report: hold-out metrics beside mean and deviation over the folds."""
    keys = ["ticker", "feature_set", "task", "model"]
    folded = scores.where((F.col("fold") > blocks.HOLDOUT) & ~F.col("model").isin(training.selection.FLOORS))
    stats = metrics.fold_statistics(folded.withColumn("_score", _main()), *keys, score="_score").withColumnsRenamed(
        {"fold_mean": "selection_fold_mean", "fold_std": "selection_fold_std", "n_folds": "selection_n_folds"}
    )
    return scores.where(F.col("fold") == blocks.HOLDOUT).drop("fold").join(stats, keys, "left")


@dataclass
class Run:
    """A training run of the linear candidates: reports as tables."""

    chosen: DataFrame
    fitted: DataFrame
    comparison: DataFrame
    winners: DataFrame
    kept: DataFrame
    manifest: DataFrame
    stability: DataFrame


def manifest(kept: DataFrame, fitted: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Kept models with their own columns and coefficients, as fitted on the training region."""
    names = _listed(blocks.all_columns(sets))
    held = fitted.where(F.col("fold") == blocks.HOLDOUT).drop("fold")
    joined = kept.select("ticker", "task", "feature_set", "model").join(held, ["ticker", "task", "feature_set"], "left")
    naive = F.col("model") == training.PERSISTENCE
    return joined.select(
        "ticker", "task", "model",
        F.when(naive, _listed(["ret_1d"])).otherwise(probe.at_places(names, F.col("places"))).alias("columns"),
        F.when(naive, F.lit(0.0)).otherwise(F.col("intercept")).alias("intercept"),
        F.when(naive, F.array(F.lit(1.0))).otherwise(F.col("coefficients")).alias("coefficients"),
    )


def stability(served: DataFrame, fitted: DataFrame, kept: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Full-history walk-forward rows of the kept models; without a fold the row stays, with no mean and 0 folds.

    ``served`` and ``fitted`` are of a marking without hold-out.
    """
    scores = region_metrics(predictions(served, fitted, sets)).where(F.col("fold") > blocks.HOLDOUT)
    keys = ["ticker", "feature_set", "task", "model"]
    stats = metrics.fold_statistics(scores.withColumn("_score", _main()), *keys, score="_score")
    joined = kept.select(*keys, F.col("metric").alias("single_window_metric")).join(stats, keys, "left")
    return joined.select(
        "ticker", "task", "feature_set", "model", "single_window_metric", F.col("fold_mean").alias("walk_forward_mean"),
        F.col("fold_std").alias("walk_forward_std"), F.coalesce("n_folds", F.lit(0)).cast("long").alias("n_folds"),
    )


def train(
    table: DataFrame, sets: dict[str, list[str]] = schemas.FEATURE_SETS, top: int = config.TOP_FEATURES, trees: int = probe.TREES
) -> Run:
    """Choose columns, compare all linear candidates on every set and task, pick what each instrument keeps."""
    rows = settle(blocks.marked(table, sets))
    served = blocks.by_set(rows, sets)
    chosen = settle(choose(served, sets, top, trees))
    history = settle(blocks.marked(table, sets, holdout=False))
    walked = blocks.by_set(history, sets)
    both = settle(fit_markings({"holdout": (rows, served), "history": (history, walked)}, chosen, sets, top))
    fitted, refitted = (both.where(F.col("marking") == name).drop("marking") for name in ("holdout", "history"))
    compared = settle(comparison(region_metrics(predictions(served, fitted, sets))))
    won = settle(training.winners(compared))
    kept = settle(training.shipped(won))
    return Run(
        chosen, fitted, compared, won, kept, manifest(kept, fitted, sets), stability(walked, refitted, kept, sets)
    )


def normal_equations(rows: DataFrame, fitted: DataFrame, sets: dict[str, list[str]], alpha: float = 1.0) -> DataFrame:
    """(ticker, feature_set, fold, n_rows, n_columns, gap): how far ridge models are from solving their equations.

    Recomputed from the rows: for every chosen column the standardised residual sum less the penalty's pull, and the
    residual sum of the intercept, relative to the size of the targets.
    """
    ridge = fitted.where("task = 'regression'")
    train = blocks.training_rows(blocks.by_set(rows, sets)).join(ridge, REGION)
    error = F.col("target_return") - linear.linear_value(probe.at_places(F.col("x"), F.col("places")))
    cells = train.select(
        *REGION, error.alias("e"), F.abs("target_return").alias("size"), F.size(F.array_distinct("places")).alias("n_columns"),
        F.posexplode(F.arrays_zip(probe.at_places(F.col("x"), F.col("places")).alias("v"), F.col("coefficients").alias("b"))).alias("k", "c"),
    )
    by_column = cells.groupBy(*REGION, "k").agg(
        F.count("*").alias("n"), F.max("n_columns").alias("n_columns"), F.sum("e").alias("e"), F.sum("size").alias("size"),
        F.covar_pop("e", "c.v").alias("pull"), F.stddev_pop("c.v").alias("s"), F.max("c.b").alias("b"),
    )
    flat = F.col("s") <= 1e-12
    column_gap = F.when(flat, F.abs(F.col("b"))).otherwise(F.abs(F.col("n") * F.col("pull") / F.col("s") - alpha * F.col("b") * F.col("s")))
    return by_column.groupBy(*REGION).agg(
        F.max("n").alias("n_rows"), F.max("n_columns").alias("n_columns"),
        F.max(F.greatest(F.abs("e"), column_gap) / F.col("size")).alias("gap"),
    )
