import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from catalogue import models
from quaymark import schemas
from quaymark.models import linear, store, trees
from quaymark.operators import features, intraday, splits
from quaymark.plans import intraday_training, predict, shipping, training
from quaymark.session import work_path
from quaymark.sources import derived
from quaymark.streaming import bars as stream_bars
from quaymark.streaming import snapshots as stream_snapshots

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 300
    pdf = pd.DataFrame(rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 50, 1], columns=COLUMNS)
    pdf["ticker"] = np.where(rng.random(n) < 0.7, "HOT", "COLD")
    pdf["c"] = np.where(pdf.ticker == "COLD", 4.0, pdf.c)  # constant inside one group
    pdf["y"] = 0.5 * pdf.a - 0.02 * pdf.b + rng.normal(size=n)
    pdf["d"] = (pdf.y > pdf.y.mean()).astype(int)
    pdf["w"] = rng.random(n) + 0.5
    return spark.createDataFrame(pdf), pdf


def test_ridge_equals_normal_equations(table):
    frame, pdf = table
    for row in linear.fit_ridge(frame, COLUMNS, "y", "ticker").collect():
        g = pdf[pdf.ticker == row["ticker"]]
        x, y = g[COLUMNS].to_numpy(), g.y.to_numpy()
        scale = np.where(x.std(0) > 1e-9, x.std(0), 1)
        z = (x - x.mean(0)) / scale
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / scale
        assert np.allclose(row["coefficients"], w, atol=1e-10) and row["n"] == len(g)
        assert row["intercept"] == pytest.approx(y.mean() - w @ x.mean(0))


def test_logistic_gradient_vanishes(table):
    frame, pdf = table
    for row in linear.fit_logistic(frame, COLUMNS, "d", "ticker", weight="w").collect():
        g = pdf[pdf.ticker == row["ticker"]]
        x, y, w = g[COLUMNS].to_numpy(), g.d.to_numpy(), g.w.to_numpy()
        scale = np.where(x.std(0) > 1e-9, x.std(0), 1)
        z, beta = (x - x.mean(0)) / scale, np.array(row["coefficients"]) * scale
        p = 1 / (1 + np.exp(-(row["intercept"] + x @ row["coefficients"])))
        assert np.abs(z.T @ (w * (p - y)) + beta).max() < 1e-8 and abs((w * (p - y)).sum()) < 1e-8


def test_far_from_zero_and_separable_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    rows = [("FAR", 1e8 + float(v), 2 * float(v), int(v > 0)) for v in x]
    frame = spark.createDataFrame(rows, "ticker string, a double, y double, d int")
    ridge = linear.fit_ridge(frame, ["a"], "y", "ticker", alpha=0.0).first()
    assert ridge["coefficients"][0] == pytest.approx(2.0, rel=1e-6)
    fitted = linear.fit_logistic(frame, ["a"], "d", "ticker").first()
    assert fitted["converged"] and fitted["coefficients"][0] > 1
    assert not linear.fit_logistic(frame, ["a"], "d", "ticker", steps=1).first()["converged"]


def test_scoring_by_manifest_uses_own_columns(spark, table):
    frame, _ = table
    models = spark.createDataFrame(
        [("HOT", ["a"], 1.0, [2.0]), ("COLD", ["b", "c"], 0.0, [1.0, 10.0])],
        "ticker string, columns array<string>, intercept double, coefficients array<double>",
    )
    holed = frame.withColumn("a", F.when(F.col("ticker") == "HOT", F.col("a")))
    got = linear.score_by_manifest(holed, models, "out", COLUMNS)
    want = F.when(F.col("ticker") == "HOT", 1 + 2 * F.col("a")).otherwise(F.col("b") + 10 * F.col("c"))
    assert got.where(F.abs(F.col("out") - want) > 1e-9).count() == 0
    assert got.where(F.col("out").isNull()).count() == 0
    path = work_path(spark, "models")
    store.save(models.withColumn("task", F.lit("regression")), path)
    assert store.load(spark, path).count() == 2


def test_required_columns(spark):
    rows = [("A", "regression", "m", ["x", "b"]), ("A", "classification", "m", ["b", "a"])]
    manifest = spark.createDataFrame(rows, schemas.MANIFEST)
    assert store.required_columns(manifest).first()["columns"] == ["a", "b", "x"]


@pytest.fixture(scope="module")
def own(spark):
    frame = features.own_features(derived.all_bars(spark, FOLDER)).persist()
    yield frame
    frame.unpersist()


def test_training_end_to_end(spark, own):
    sets = {"baseline": ["ret_1d", "hl_range"]}
    comparison = training.train_grouped(own, sets).persist()
    assert comparison.count() == 6 * 2 * 3
    won = training.winners(comparison)
    kept = training.shipped(won).persist()
    assert kept.count() == 12 and kept.where(F.col("model").startswith("baseline_zero")).count() == 0
    models = training.fit_shipped(own, kept, sets).persist()
    assert models.count() == 12
    scored = training.score_shipped(own, models)
    assert scored.where("complete and (up_probability < 0 or up_probability > 1)").count() == 0
    assert predict.next_day(scored).count() == 6
    data = {"baseline": features.dataset(own, sets["baseline"])}
    assert training.stability_report(data, kept, sets).count() == 12
    assert training.ticker_summary(won, kept).where(F.col("baseline_reg_rmse").isNull()).count() == 0


def tiny_plan(recency):
    return training.TreePlan(
        draws=1, tuning_folds=2, recency=recency,
        grids={
            "forest": {"numTrees": [3], "maxDepth": [2], "minInstancesPerNode": [5], "featureSubsetStrategy": ["sqrt"]},
            "boost": {"maxIter": [2], "maxDepth": [2], "stepSize": [0.1]},
        },
        probe={"numTrees": 3, "maxDepth": 2, "minInstancesPerNode": 5},
    )


def test_feature_ranking_covers_every_instrument(spark, own, monkeypatch):
    used, fit = [], trees.fit_tree
    monkeypatch.setattr(trees, "fit_tree", lambda *a, **k: used.append(a[4]) or fit(*a, **k))
    rows = models.rf_feature_topk(spark, FOLDER).collect()
    tickers = {r["ticker"] for r in own.select("ticker").distinct().collect()}
    ranks = {t: sorted(r["rank"] for r in rows if r["ticker"] == t) for t in tickers}
    assert ranks == {t: list(range(1, 21)) for t in tickers}
    assert used == [{"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 5}] * len(tickers)


def test_tree_candidates_save_and_load(spark, own):
    market = features.dataset(own.where("ticker = 'MARKET'"), schemas.OWN_FEATURES)
    metrics_table, models, chosen, _ = training.tree_candidates(market, schemas.OWN_FEATURES, "regression", tiny_plan(True))
    rows = {r["model"]: r for r in metrics_table.collect()}
    assert set(rows) == {
        "random_forest_tuned", "hist_gradient_boosting_tuned", "random_forest_recency_weighted",
        "hist_gradient_boosting_recency_weighted", "voting_ensemble",
    }
    assert len(chosen) == 20 and all(r["n_folds"] == 4 and r["rmse"] > 0 for r in rows.values())
    folder = work_path(spark, "trees")
    trees.save_models(models, folder)
    loaded = trees.load_models(models, folder)
    assert all(isinstance(m, PipelineModel) for m in loaded.values())
    name = "random_forest_tuned"
    both = trees.score_tree(trees.score_tree(market, models[name], "regression", "p"), loaded[name], "regression", "q")
    assert both.where("p <> q").count() == 0


def test_stored_tree_and_vote_are_served(spark, own):
    market = own.where("ticker = 'MARKET'")
    sets = {"baseline": ["ret_1d", "hl_range", "vol_change"]}
    run = shipping.train(market, sets, tiny_plan(False))
    assert run.comparison.count() == 12 and run.kept.count() == 2
    forced = F.when(F.col("task") == "regression", F.lit("voting_ensemble")).otherwise(F.lit("random_forest_tuned"))
    run.kept = run.kept.withColumn("model", forced)
    folder = work_path(spark, "store")
    manifest = shipping.ship(market, run, folder, sets)
    assert {(r["task"], r["model"]) for r in manifest.collect()} == {
        ("regression", "voting_ensemble"), ("classification", "random_forest_tuned"),
    }
    served = shipping.serve(spark, market, folder)
    assert served.count() == market.count()
    assert served.where("complete").count() == features.complete_rows(market, sets["baseline"]).count()
    assert served.where("up_probability < 0 or up_probability > 1").count() == 0
    tables = shipping.reports(run, market, sets)
    assert set(tables) == {"model_comparison", "walk_forward_stability", "ticker_summary"}
    assert {(r["model"], r["n_folds"]) for r in tables["walk_forward_stability"].collect()} == {
        ("voting_ensemble", 4), ("random_forest_tuned", 4),
    }


def test_intraday_tree_candidates(spark):
    folder = "/root/testdata/sf0.01"
    snaps = intraday.snapshots(derived.intraday_bars(spark, folder), derived.event_days(spark, folder))
    marked = splits.day_split(snaps.where("ticker = 'click'"), "ticker", min_days=3).persist()
    small = {"numTrees": 3, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 2}
    predictions, models = intraday_training.tree_predictions(
        marked.where("split = 'train'"), marked.where("split = 'test'"), *small
    )
    table, buckets = intraday_training.summarise(predictions)
    assert table.count() == 2 and set(models) == {"random_forest", "hist_gradient_boosting"} and buckets.count() > 0


def test_search_draws_are_seeded():
    assert trees.draws("forest", 10) == trees.draws("forest", 10) and len(trees.draws("boost", 10)) == 10
    assert len(trees.draws("boost", 99, grid={"maxIter": [1, 2]})) == 2


def test_intraday_training(spark):
    bars, daily = derived.intraday_bars(spark, "/root/testdata/sf0.01"), derived.event_days(spark, "/root/testdata/sf0.01")
    table, buckets = intraday_training.train_intraday(bars, daily, min_rows=20, min_days=3)
    assert table.count() == 10 and buckets.where("model = 'baseline_zero_return'").count() == 0
    assert intraday_training.train_intraday(bars, daily)[0].count() == 0  # fewer than 200 rows each
    snaps = intraday.snapshots(bars, daily)
    assert intraday_training.fit_intraday(snaps.where("date >= date'2024-01-01'")).count() >= 0


def test_stream_equals_batch_on_closed_windows(spark):
    stream = stream_bars.bars(stream_bars.tick_stream(spark, FOLDER))
    streamed = stream_bars.write_available(stream, spark, "bars")
    batch = stream_bars.bars(derived.ticks(spark, FOLDER))
    last = derived.ticks(spark, FOLDER).agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    closed = batch.where(F.col("ts_end") <= F.lit(last))
    assert streamed.exceptAll(closed).count() == 0 and closed.exceptAll(streamed).count() == 0
    assert batch.count() > closed.count()


def test_stream_of_many_files_keeps_session_state(spark):
    path = work_path(spark, "bars-by-hour")
    bars = derived.intraday_bars(spark, FOLDER).where("date(ts) >= date'2024-01-22'")
    hours = [r["h"] for r in bars.select(F.date_trunc("hour", "ts").alias("h")).distinct().orderBy("h").collect()][:12]
    for hour in hours:
        bars.where(F.date_trunc("hour", "ts") == F.lit(hour)).coalesce(1).write.mode("append").parquet(path)
    source = (
        spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "1 hour")
    )
    daily = derived.event_days(spark, FOLDER)
    got = stream_bars.write_available(stream_snapshots.snapshot_stream(source, daily), spark, "snaps")
    kept = bars.where(F.date_trunc("hour", "ts").isin(hours))
    running = intraday.running_session(intraday.with_session_day(kept)).where("bar_no >= 2")
    want = intraday.snapshot_features(running, intraday.day_context(daily)).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_logistic_sums_need_no_row_sort(spark, monkeypatch):
    """150 groups, more than an object aggregation holds in memory: only sums per batch and group are aggregated."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=6000) > 0).astype(int)
    rows = [(i % 150, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    plans, keep = [], linear.settle
    frame = keep(spark.createDataFrame(rows, "k int, a double, b double, y int"))
    monkeypatch.setattr(linear, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    got = {r["k"]: r for r in linear.fit_logistic(frame, ["a", "b"], "y", "k").collect()}
    steps = [p for p in plans if "MapInPandas" in p]
    assert steps and all("MapInArrow" in p and "Aggregate [_g" in p for p in steps)
    assert len(got) == 150 and all(r["converged"] for r in got.values())
    for k in (0, 149):
        own = x[k::150]
        mean, scale = own.mean(0), own.std(0)
        z, coef, bias = (own - mean) / scale, np.zeros(2), 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(bias + z @ coef)))
            design = np.column_stack([np.ones(len(z)), z])
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.0, 1.0, 1.0])
            move = np.linalg.solve(hessian, design.T @ (y[k::150] - p) - np.append(0.0, coef))
            bias, coef = bias + move[0], coef + move[1:]
        assert got[k]["coefficients"] == pytest.approx(coef / scale, rel=1e-8)
        assert got[k]["intercept"] == pytest.approx(bias - mean @ (coef / scale), rel=1e-8, abs=1e-10)


def test_packed_is_what_unpack_reads():
    rng = np.random.default_rng(1)
    mean, square = rng.normal(size=4), rng.normal(size=(4, 4))
    square = square + square.T
    first, second = linear.unpack(linear.packed(mean, square), 4)
    assert (first == mean).all() and (second == square).all()
