"""Columns chosen per group, ridge from block moments, and the training run on them."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.models import blocks, linear, probe
from quaymark.operators import features, splits
from quaymark.plans import selected, training
from quaymark.session import settle

NAMES = [f"f{k}" for k in range(6)]
SETS = {"baseline": ["ret_1d", *NAMES[:2]], "with_macro": ["ret_1d", *NAMES[:4]], "with_macro_and_news": ["ret_1d", *NAMES]}


def table_of(spark, sizes, seed=3):
    """Instruments whose return follows f1 and f4 (far from 0), with holes in the wider sets' columns."""
    rng, rows = np.random.default_rng(seed), []
    for ticker, n in sizes.items():
        x = rng.normal(size=(n, 7))
        for i in range(n):
            cells = [float(v) for v in x[i]]
            y = 0.5 * cells[2] - 0.8 * cells[5] + 0.1 * float(rng.normal())
            cells[5] += 1e6
            if i < 20:
                cells[3] = None
            if i % 9 == 4:
                cells[6] = None
            day = datetime.date(2020, 1, 1) + datetime.timedelta(i)
            rows.append((ticker, day, 1.0, *cells, y if i < n - 1 else None, int(y > 0) if i < n - 1 else None))
    names = ", ".join(f"{c} double" for c in ["ret_1d", *NAMES])
    return spark.createDataFrame(rows, f"ticker string, date date, close double, {names}, target_return double, target_direction int")


@pytest.fixture(scope="module")
def table(spark):
    return settle(table_of(spark, {"A": 400, "B": 233, "C": 70, "D": 25}))


def test_blocks_are_the_splits_and_folds(table):
    rows = blocks.by_set(blocks.marked(table, SETS), SETS)
    for name, columns in SETS.items():
        marked = splits.chrono_split(features.dataset(table, columns), "ticker")
        train = marked.where("split = 'train'").drop("split")
        folds = splits.expanding_folds(train, "ticker")
        want = {("test", r["ticker"], -1, r["date"]) for r in marked.where("split = 'test'").collect()}
        want |= {("train", r["ticker"], -1, r["date"]) for r in train.collect()}
        want |= {(r["role"], r["ticker"], r["fold"], r["date"]) for r in folds.collect()}
        own = rows.where(F.col("feature_set") == name)
        got = {("test", r["ticker"], r["fold"], r["date"]) for r in own.where("fold IS NOT NULL").collect()}
        got |= {("train", r["ticker"], r["fold"], r["date"]) for r in blocks.training_rows(own).collect()}
        assert got == want


def test_ridge_from_blocks_equals_ridge_on_the_rows(spark, table):
    rows = settle(blocks.marked(table, SETS))
    names = blocks.all_columns(SETS)
    wanted = {"A": [0, 2, 5], "B": [6, 1], "C": [2], "D": [0]}
    chosen = spark.createDataFrame([(t, "with_macro_and_news", p) for t, p in wanted.items()], "ticker string, feature_set string, places array<int>")
    sums = blocks.training_moments(rows, SETS).join(chosen, ["ticker", "feature_set"])
    found = {(r["ticker"], r["fold"]): r for r in blocks.solve_ridge(sums, len(names)).collect()}
    fit_rows, _ = training.holdout_and_folds(features.dataset(table, SETS["with_macro_and_news"]))
    for ticker in ("A", "B"):
        columns = [names[k] for k in wanted[ticker]]
        plain = linear.fit_ridge(fit_rows.where(F.col("ticker") == ticker), columns, "target_return", "ticker", "fold").collect()
        assert len(plain) == 5
        for r in plain:
            got = found[ticker, r["fold"]]
            assert got["n"] == r["n"] and got["intercept"] == pytest.approx(r["intercept"], rel=1e-6, abs=1e-6)
            assert got["coefficients"] == pytest.approx(r["coefficients"], rel=1e-6, abs=1e-9)


def test_probe_finds_the_columns(spark, table):
    served = blocks.by_set(blocks.marked(table, SETS), SETS)
    chosen = selected.choose(served, SETS, top=3, trees=30).collect()
    names = blocks.all_columns(SETS)
    found = {(r["ticker"], r["feature_set"], r["task"]): [names[k] for k in r["places"]] for r in chosen}
    for task in training.TASKS:
        assert {"f1", "f4"} <= set(found["A", "with_macro_and_news", task]) and len(found["A", "with_macro_and_news", task]) == 3
        assert found["A", "baseline", task] == SETS["baseline"]
        assert found["A", "with_macro", task][0] == "f1"
    again = selected.choose(served, SETS, top=3, trees=30).collect()
    assert sorted(map(str, chosen)) == sorted(map(str, again))


def test_tree_gains_split_the_right_column():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 2] > 0.3).astype(float)
    share = probe.tree_gains(probe.binned(x), y - y.mean(), np.random.default_rng(1), 4)
    assert share.argmax() == 2 and share[2] > 0.9 and share.sum() == pytest.approx(1)
    assert not probe.tree_gains(probe.binned(x[:4]), y[:4], rng, 4).any()
    assert not probe.tree_gains(probe.binned(np.ones((50, 2))), y[:50], rng, 2).any()


def test_run_serves_chosen_columns(table):
    run = selected.train(table, SETS, top=3, trees=20)
    told = {(r["ticker"], r["task"]): r for r in run.manifest.collect()}
    kept = {(r["ticker"], r["task"]): r for r in run.kept.collect()}
    assert set(told) == set(kept) and {t for t, _ in told} >= {"A", "B"}
    for key, r in told.items():
        assert len(r["columns"]) == len(r["coefficients"]) == (1 if r["model"] == training.PERSISTENCE else 3)
    # The return is linear in f1 and f4, which the widest set alone holds together.
    assert kept["A", "regression"]["model"] == "linear_ridge" and kept["A", "regression"]["feature_set"] == "with_macro_and_news"
    assert {"f1", "f4"} <= set(told["A", "regression"]["columns"])
    stable = {(r["ticker"], r["task"]): r for r in run.stability.collect()}
    assert set(stable) == set(kept)
    assert all(r["single_window_metric"] is not None for r in stable.values())
    assert stable["A", "regression"]["n_folds"] == 4 and stable["A", "regression"]["walk_forward_mean"] < 0.2
    # Too few rows for a fold: the row stays.
    assert stable["C", "regression"]["n_folds"] in (0, 4)
    models = run.manifest.where("task = 'regression'")
    scored = linear.score_by_manifest(table, models, "p", blocks.all_columns(SETS)).where("ticker = 'A' AND p IS NOT NULL")
    assert scored.count() > 300 and scored.agg(F.corr("p", "target_return")).first()[0] > 0.99


def test_kept_models_without_folds_stay(spark):
    small = settle(table_of(spark, {"S": 45}))
    run = selected.train(small, {"baseline": SETS["baseline"]}, top=3, trees=5)
    (row,) = run.stability.where("task = 'regression'").collect()
    assert row["n_folds"] == 0 and row["walk_forward_mean"] is None and row["single_window_metric"] is not None
    assert run.kept.where("selection_basis = 'single_holdout_fallback'").count() == 2


def test_tree_counts_the_tried_columns_only(monkeypatch):
    rng, cells = np.random.default_rng(0), []
    x = rng.normal(size=(400, 30))
    y = (x[:, 2] > 0.3).astype(float)
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda at, *rest, **named: cells.append(len(at)) or count(at, *rest, **named))
    share = sum(probe.tree_gains(probe.binned(x), y - y.mean(), np.random.default_rng(k), 5) for k in range(20))
    assert share.argmax() == 2 and max(cells) <= 400 * 5


def test_run_fits_logistic_models_of_all_regions_at_once(monkeypatch, table):
    calls, fit = [], linear.fit_logistic

    def counted(*given, **named):
        calls.append(given[3:])
        return fit(*given, **named)

    monkeypatch.setattr(linear, "fit_logistic", counted)
    selected.train(table, SETS, top=3, trees=5)
    assert len(calls) == 1


def test_markings_fitted_together_equal_each_alone(table):
    marked = {name: settle(blocks.marked(table, SETS, holdout=name == "holdout")) for name in ("holdout", "history")}
    pairs = {name: (rows, blocks.by_set(rows, SETS)) for name, rows in marked.items()}
    chosen = settle(selected.choose(pairs["holdout"][1], SETS, top=3, trees=5))
    keys = ("marking", *selected.REGION, "task")
    together = {tuple(r[k] for k in keys): r for r in selected.fit_markings(pairs, chosen, SETS, 3).collect()}
    alone = {}
    for name, (rows, served) in pairs.items():
        for r in selected.fit_regions(rows, served, chosen, SETS, 3).collect():
            alone[name, *(r[k] for k in keys[1:])] = r
    assert set(together) == set(alone) and len({k[0] for k in alone}) == 2
    for key, r in alone.items():
        assert together[key]["intercept"] == pytest.approx(r["intercept"], rel=1e-6, abs=1e-6)
        assert together[key]["coefficients"] == pytest.approx(r["coefficients"], rel=1e-6, abs=1e-9)


def test_normal_equations_tell_a_wrong_model(spark, table):
    rows = settle(blocks.marked(table, SETS))
    chosen = spark.createDataFrame([("A", "baseline", [0, 1, 2])], "ticker string, feature_set string, places array<int>")
    sums = blocks.training_moments(rows, SETS).join(chosen, ["ticker", "feature_set"])
    fitted = settle(blocks.solve_ridge(sums, 7).withColumn("task", F.lit("regression")))
    assert selected.normal_equations(rows, fitted, SETS).agg(F.max("gap")).first()[0] < 1e-9
    off = fitted.withColumn("coefficients", F.transform("coefficients", lambda c: c * 1.001))
    assert selected.normal_equations(rows, off, SETS).agg(F.min("gap")).first()[0] > 1e-9
