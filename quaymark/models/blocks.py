"""Ridge models of every instrument, feature set and fold from one pass over the feature table.

Folds expand, so the rows of an instrument fall into blocks of consecutive days: block 0 is trained on by every fold,
block k is tested by fold k - 1 and trained on by the later ones, the last block is the hold-out. Every feature set has
complete rows and blocks of its own. Rows that lie in the same blocks of all sets are a cell; its second moments over
all columns are taken once. The moments of a training region are sums over cells, and a model on chosen columns is the
solution for that part of the matrix, so more sets, folds or choices of columns cost no further pass.

Moments are taken about each column's first value, which keeps the digits of columns far from 0.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config
from quaymark.models import linear

HOLDOUT = -1


def all_columns(sets: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(c for columns in sets.values() for c in columns))


def marked(
    table: DataFrame, sets: dict[str, list[str]], holdout: bool = True,
    folds: int = config.STABILITY_FOLDS, min_rows: int = config.MIN_FOLD_ROWS,
) -> DataFrame:
    """(ticker, date, x, first, blocks, targets): all columns as ``x``, and the row's block in every set (null: none).

    ``first`` holds each column's first value. With ``holdout`` the newest max(15%, 30) complete rows are block
    ``folds + 1``; without it the folds reach to the newest row. Too few rows for a fold leave block 0 only.
    """
    columns = all_columns(sets)
    days = Window.partitionBy("ticker").orderBy("date")
    whole = days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    targets = ["target_return", "target_direction"]
    numbers = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    rows = table.select("ticker", "date", *targets, "close", *[v.alias(c) for c, v in numbers.items()])
    for i, own in enumerate(sets.values()):
        complete = F.lit(True)
        for c in [*own, *targets]:
            complete = complete & F.col(c).isNotNull()
        rows = rows.withColumn(f"_in{i}", complete.cast("int"))
    rows = rows.withColumns(
        {f"_row{i}": F.sum(f"_in{i}").over(so_far) - 1 for i in range(len(sets))}
        | {f"_all{i}": F.sum(f"_in{i}").over(whole) for i in range(len(sets))}
        | {f"_first_{c}": F.first(c, ignorenulls=True).over(whole) for c in columns}
    )

    def block(i: int) -> Column:
        n, row = F.col(f"_all{i}"), F.col(f"_row{i}")
        tested = F.greatest(F.floor(n * F.lit(config.TEST_FRACTION)), F.lit(config.MIN_TEST_ROWS)) if holdout else F.lit(0)
        size = F.floor((n - tested) / (folds + 1))
        start = n - tested - folds * size
        fold = F.when(size >= min_rows, F.greatest(F.lit(0), F.floor((row - start) / size) + 1)).otherwise(F.lit(0))
        place = F.when(row >= n - tested, F.lit(folds + 1)).otherwise(fold)
        return F.when(F.col(f"_in{i}") == 1, place.cast("int"))

    return rows.select(
        "ticker", "date", *targets, "close", F.array(*columns).alias("x"),
        F.array(*[f"_first_{c}" for c in columns]).alias("first"), F.array(*[block(i) for i in range(len(sets))]).alias("blocks"),
    )


def _served(sets: dict[str, list[str]]) -> Column:
    """(feature_set, block) of every set that the row is complete in."""
    each = F.array(*[F.struct(F.lit(s).alias("feature_set"), F.get("blocks", F.lit(i)).alias("block")) for i, s in enumerate(sets)])
    return F.explode(F.filter(each, lambda s: s["block"].isNotNull()))


def _fold_tested(block: Column, folds: int) -> Column:
    return F.when(block == folds + 1, F.lit(HOLDOUT)).otherwise(block - 1)


def _folds_trained(block: Column, last: Column, folds: int) -> Column:
    """The folds that train on a block: all later ones, and the hold-out model's, if there are any."""
    later = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: (k >= block) & (k < last))
    return F.when(block <= folds, F.concat(later, F.array(F.lit(HOLDOUT)))).otherwise(F.array().cast("array<int>"))


def by_set(rows: DataFrame, sets: dict[str, list[str]], folds: int = config.STABILITY_FOLDS) -> DataFrame:
    """One row for every set a day is complete in, with ``feature_set``, ``block`` and the ``fold`` that tests it (block 0: none)."""
    served = rows.withColumn("_s", _served(sets)).withColumns({"feature_set": F.col("_s.feature_set"), "block": F.col("_s.block")})
    return served.withColumn("fold", F.when(F.col("block") > 0, _fold_tested(F.col("block"), folds))).drop("_s")


def training_rows(served: DataFrame, folds: int = config.STABILITY_FOLDS) -> DataFrame:
    """Rows of :func:`by_set`, once for every fold that trains on them."""
    group = Window.partitionBy("ticker", "feature_set")
    last = F.max(F.when(F.col("block") <= folds, F.col("block"))).over(group)
    return served.drop("fold").withColumn("_last", last).withColumn(
        "fold", F.explode(_folds_trained(F.col("block"), F.col("_last"), folds))
    ).drop("_last")


def training_moments(rows: DataFrame, sets: dict[str, list[str]], folds: int = config.STABILITY_FOLDS) -> DataFrame:
    """(ticker, feature_set, fold, total, products, first) of every training region; the last variable is the return."""
    shifted = F.zip_with("x", "first", lambda x, f: F.coalesce(x - f, F.lit(0.0)))
    data = rows.where(F.exists("blocks", lambda b: b.isNotNull())).select(
        "ticker", "blocks", F.concat(shifted, F.array("target_return")).alias("_x"), F.lit(1.0).alias("_one")
    )
    cells = linear.moments(data, "_x", "_one", "ticker", "blocks")
    served = cells.withColumn("_s", _served(sets)).select("ticker", "total", "products", "_s.*")
    regions = training_rows(served, folds)
    firsts = rows.groupBy("ticker").agg(F.first("first").alias("first"))
    return (
        regions.groupBy("ticker", "feature_set", "fold")
        .agg(
            F.sum("total").alias("total"),
            vector_to_array(Summarizer.mean(array_to_vector(F.col("products")), F.col("total"))).alias("products"),
        )
        .join(firsts, "ticker")
    )


def solve_ridge(sums: DataFrame, size: int, alpha: float = 1.0) -> DataFrame:
    """(ticker, feature_set, fold, n, intercept, coefficients, places) from moments joined with ``places``.

    Ridge on columns standardised by their population deviation in the region, in raw units.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for n, products, first, places in zip(batch["total"], batch["products"], batch["first"], batch["places"]):
                own = np.asarray(places, dtype=int)
                mean, square = linear.unpack(np.asarray(products, dtype=float), size + 1)
                spread = square - np.outer(mean, mean)
                deviation = np.sqrt(np.clip(np.diag(spread)[own], 0.0, None))
                flat = deviation <= 1e-12 * (1.0 + np.abs(mean[own]))
                safe = np.where(flat, 1.0, deviation)
                gram = n * spread[np.ix_(own, own)] / np.outer(safe, safe)
                cross = n * spread[own, size] / safe
                gram[flat, :] = gram[:, flat] = cross[flat] = 0.0
                raw = np.linalg.solve(gram + alpha * np.eye(len(own)), cross) / safe
                base = np.asarray(first, dtype=float)[own] + mean[own]
                found.append((n, mean[size] - raw @ base, raw.tolist()))
            out = batch[["ticker", "feature_set", "fold", "places"]].copy()
            out[["n", "intercept", "coefficients"]] = pd.DataFrame(found, index=batch.index, columns=["n", "i", "c"])
            yield out

    form = "ticker string, feature_set string, fold int, places array<int>, n double, intercept double, coefficients array<double>"
    wanted = ["ticker", "feature_set", "fold", "total", "products", "first", "places"]
    return sums.select(*wanted).mapInPandas(solve, form)
