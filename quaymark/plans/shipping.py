"""Full training run: grouped and tree candidates compete, winners are stored and served.

The model store is a folder: ``linear`` (coefficient table), ``manifest`` and one pipeline per tree
member at ``trees/<ticker>/<task>/<member>``.
"""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import weights
from quaymark.models import linear, trees
from quaymark.operators import features, metrics, splits
from quaymark.plans import training
from quaymark.session import settle

VOTE = "voting_ensemble"
VOTERS = ["random_forest_tuned", "hist_gradient_boosting_tuned"]
TREES = [*VOTERS, "random_forest_recency_weighted", "hist_gradient_boosting_recency_weighted", VOTE]


@dataclass
class Run:
    """What a training run found: reports as tables, tree pipelines by (ticker, set, task)."""

    comparison: DataFrame
    winners: DataFrame
    kept: DataFrame
    trees: dict = field(default_factory=dict)


def train(
    table: DataFrame,
    sets: dict[str, list[str]] = schemas.FEATURE_SETS,
    plan: training.TreePlan | None = None,
    tasks: tuple[str, ...] = training.TASKS,
) -> Run:
    """Compare all candidates on every feature set and task and pick what each instrument keeps.

    ``table`` is the feature table of all instruments; ``plan`` adds the tree candidates.
    """
    table = settle(table)
    parts, found = [], {}
    tickers = [r["ticker"] for r in table.select("ticker").distinct().orderBy("ticker").collect()] if plan else []
    for name, columns in sets.items():
        data = features.dataset(table, columns)
        for task in tasks:
            parts.append(training.comparison_rows(training.grouped_candidates(data, columns, task), name))
            for ticker in tickers:
                own = data.where(F.col("ticker") == ticker)
                rows, models, chosen, specs = training.tree_candidates(own, columns, task, plan)
                found[ticker, name, task] = (models, chosen, specs)
                parts.append(training.comparison_rows(settle(rows), name))
    comparison = linear.stack(parts)
    missing = [c for c in ("rmse", "balanced_accuracy") if c not in comparison.columns]
    comparison = settle(comparison.withColumns({c: F.lit(None).cast("double") for c in missing}))
    won = settle(training.winners(comparison))
    return Run(comparison, won, settle(training.shipped(won)), found)


def _tree_winners(kept: DataFrame) -> list:
    """One small row per instrument and task won by a tree candidate."""
    return kept.where(F.col("model").isin(TREES)).select("ticker", "task", "model", "feature_set").collect()


def ship(table: DataFrame, run: Run, folder: str, sets: dict[str, list[str]] = schemas.FEATURE_SETS) -> DataFrame:
    """Store the kept models, all fitted on the training region only; returns the manifest."""
    folder = folder.rstrip("/")
    spark = table.sparkSession
    tables = [training.fit_shipped(table, run.kept, sets)]
    manifest = []
    for row in _tree_winners(run.kept):
        ticker, task, model, name = row
        models, chosen, _ = run.trees[ticker, name, task]
        members = VOTERS if model == VOTE else [model]
        trees.save_models({m: models[m] for m in members}, f"{folder}/trees/{ticker}/{task}")
        manifest.append((ticker, task, model, chosen))
        if model == VOTE:
            own = features.dataset(table, sets[name]).where(F.col("ticker") == ticker)
            train_rows = splits.chrono_split(own, "ticker").where("split = 'train'")
            if task == "regression":
                member = linear.fit_ridge(train_rows, chosen, training.LABELS[task], "ticker").drop("n")
            else:
                weighted = train_rows.withColumn("_cw", weights.balanced_class(training.LABELS[task], "ticker"))
                member = linear.fit_logistic(weighted, chosen, training.LABELS[task], "ticker", weight="_cw")
            tables.append(
                member.select(
                    "ticker", F.lit(task).alias("task"), F.lit(VOTE).alias("model"),
                    F.array(*[F.lit(c) for c in chosen]).alias("columns"), "intercept", "coefficients",
                )
            )
    linear.stack(tables).write.mode("overwrite").parquet(f"{folder}/linear")
    by_line = spark.read.parquet(f"{folder}/linear").select("ticker", "task", "model", "columns").where(F.col("model") != VOTE)
    by_tree = spark.createDataFrame(manifest, schemas.MANIFEST)
    by_line.unionByName(by_tree).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _tree_scores(rows: DataFrame, entry, folder: str, votes: DataFrame) -> DataFrame:
    """(ticker, date, value) of one instrument's stored tree winner."""
    own = features.complete_rows(rows.where(F.col("ticker") == entry["ticker"]), list(entry["columns"]))
    members = VOTERS if entry["model"] == VOTE else [entry["model"]]
    total = F.lit(0.0)
    for member in members:
        model = PipelineModel.load(f"{folder}/trees/{entry['ticker']}/{entry['task']}/{member}")
        own = trees.score_tree(own, model, entry["task"], f"_{member}")
        total = total + F.col(f"_{member}")
    if entry["model"] != VOTE:
        return own.select("ticker", "date", total.alias("value"))
    here = votes.where((F.col("ticker") == entry["ticker"]) & (F.col("task") == entry["task"]))
    own = linear.score_linear(own, here, list(entry["columns"]), "_line", "ticker")
    line = F.col("_line") if entry["task"] == "regression" else linear.probability(F.col("_line"))
    return own.select("ticker", "date", ((total + line) / 3).alias("value"))


def serve(spark: SparkSession, table: DataFrame, folder: str) -> DataFrame:
    """Every day with the stored models' return and up-probability and whether its row was complete."""
    folder = folder.rstrip("/")
    stored = spark.read.parquet(f"{folder}/linear")
    scored = training.score_shipped(table, stored.where(F.col("model") != VOTE))
    entries = [e for e in spark.read.parquet(f"{folder}/manifest").collect() if e["model"] in TREES]
    votes = stored.where(F.col("model") == VOTE).drop("columns", "model")
    for task, output in (("regression", "pred_return"), ("classification", "up_probability")):
        parts = [_tree_scores(table, e, folder, votes) for e in entries if e["task"] == task]
        if parts:
            values = linear.stack(parts).withColumnRenamed("value", "_tree")
            scored = scored.join(values, ["ticker", "date"], "left").withColumn(
                output, F.coalesce(output, "_tree")
            ).drop("_tree")
    complete = F.col("pred_return").isNotNull() & F.col("up_probability").isNotNull()
    return scored.withColumn("complete", complete)


def tree_stability(
    data: DataFrame, columns: list[str], task: str, model: str, specs: dict, kept: DataFrame
) -> DataFrame:
    """Full-history fold statistics of one instrument's kept tree model."""
    scores = training.tree_fold_scores(data, columns, task, specs)
    here = kept.where(F.col("task") == task).select("ticker", "task", "model", F.col("metric").alias("single_window_metric"))
    if scores is None:
        return here.limit(0).withColumns(
            {"walk_forward_mean": F.lit(0.0), "walk_forward_std": F.lit(0.0), "n_folds": F.lit(0).cast("long")}
        )
    stats = metrics.fold_statistics(
        scores.where(F.col("model") == model), "ticker", "model", score=training.main_metric(task)
    ).withColumnsRenamed({"fold_mean": "walk_forward_mean", "fold_std": "walk_forward_std"})
    return here.join(stats, ["ticker", "model"]).select(
        "ticker", "task", "model", "single_window_metric", "walk_forward_mean", "walk_forward_std", "n_folds"
    )


def reports(run: Run, table: DataFrame, sets: dict[str, list[str]] = schemas.FEATURE_SETS) -> dict[str, DataFrame]:
    """The training reports by name."""
    data = {name: features.dataset(table, columns) for name, columns in sets.items()}
    stability = training.stability_report(data, run.kept, sets)
    for ticker, task, model, name in _tree_winners(run.kept):
        _, chosen, specs = run.trees[ticker, name, task]
        own = data[name].where(F.col("ticker") == ticker)
        wanted = {k: v for k, v in specs.items() if k == model or model == VOTE}
        stability = stability.unionByName(tree_stability(own, chosen, task, model, wanted, run.kept))
    return {
        "model_comparison": run.comparison,
        "walk_forward_stability": stability,
        "ticker_summary": training.ticker_summary(run.winners, run.kept),
    }

