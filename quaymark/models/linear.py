"""Ridge and logistic models of every group in the same few jobs.

A group is any key: an instrument, an instrument and fold, ... Its rows are reduced to second
moments by a partial aggregation, so neither a task nor the driver ever holds a whole group, and
the shuffle carries one vector of about p*p/2 numbers per task and group. Only these moments are
solved in Python.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.session import settle

MAX_STEPS = 25
STEP_TOLERANCE = 1e-6
LEAST_CURVATURE = 1e-6


def features_array(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def moments(rows: DataFrame, vector: str, weight: str, *keys: str) -> DataFrame:
    """(keys, total weight, weighted means of all first and second order products of ``vector``)."""
    expanded = PolynomialExpansion(degree=2, inputCol="_v", outputCol="_products").transform(
        rows.select(*keys, array_to_vector(F.col(vector)).alias("_v"), F.col(weight).cast("double").alias("_w"))
    )
    return expanded.groupBy(*keys).agg(
        F.sum("_w").alias("total"),
        vector_to_array(Summarizer.mean(F.col("_products"), F.col("_w"))).alias("products"),
    )


def unpack(products: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First moments and the symmetric matrix of second moments.

    Variable j opens at j*(j+3)/2 with its own mean, followed by its products with 0..j.
    """
    first, second = np.empty(size), np.empty((size, size))
    for j in range(size):
        at = j * (j + 3) // 2
        first[j] = products[at]
        second[j, : j + 1] = second[: j + 1, j] = products[at + 1 : at + 2 + j]
    return first, second


def packed(mean: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The inverse of :func:`unpack`."""
    return np.concatenate([np.append(mean[j], square[j, : j + 1]) for j in range(len(mean))])


def working_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_g, total weight, products) of a Newton step's rows, once for every batch and group in it.

    Rows have _g, _z, _y, _sw and their group's intercept and coefficients. The variables are ``_z`` and the working
    residual, the weights ``_sw`` times the curvature.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        group, y, weight, bias = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_y", "_sw", "intercept"))
        z, coef = (
            batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("_z", "coefficients")
        )
        with np.errstate(over="ignore"):
            p = np.clip(1.0 / (1.0 + np.exp(-(bias + (z * coef).sum(1)))), 1e-12, 1 - 1e-12)
        bend = np.maximum(p * (1 - p), LEAST_CURVATURE)
        x, weight = np.column_stack([z, (y - p) / bend]), weight * bend
        order = np.argsort(group, kind="stable")
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            own, total = weight[rows, None] * x[rows], weight[rows].sum()
            found.append((group[rows[0]], total, packed(own.sum(0) / total, own.T @ x[rows] / total)))
        at, totals, products = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(totals, pa.float64()), pa.array(products, pa.list_(pa.float64()))],
            names=["_g", "total", "products"],
        )


def _schema(frame: DataFrame, keys: tuple[str, ...], extra: str) -> str:
    kinds = dict(frame.dtypes)
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [extra])


def fit_ridge(
    rows: DataFrame, columns: list[str], label: str, *keys: str, alpha: float = 1.0
) -> DataFrame:
    """(keys, n, intercept, coefficients) of ridge regressions on standardised features.

    Scaling is by the population deviation and folded back into raw-unit coefficients. Rows are centred and scaled
    before their moments are taken, so features far from 0 lose no digits.
    """
    size = len(columns) + 1
    scaling = standardisation(rows, columns, *keys)
    centred = F.zip_with("_raw", "centre", lambda x, m: x - m)
    data = (
        rows.select(*keys, features_array(columns).alias("_raw"), F.col(label).cast("double").alias("_y"))
        .join(scaling, list(keys))
        .select(
            *keys,
            F.concat(F.zip_with(centred, F.col("scale"), lambda x, s: x / s), F.array("_y")).alias("_x"),
            F.lit(1.0).alias("_one"),
        )
    )
    sums = moments(data, "_x", "_one", *keys).join(scaling, list(keys))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for n, products, centre, scales in zip(batch["total"], batch["products"], batch["centre"], batch["scale"]):
                centre, scales = np.asarray(centre, dtype=float), np.asarray(scales, dtype=float)
                mean, square = unpack(np.asarray(products, dtype=float), size)
                spread = square - np.outer(mean, mean)
                scale = np.sqrt(np.clip(np.diag(spread)[:-1], 0.0, None))
                flat = scale < 0.5  # constant features: nothing is left of them
                safe = np.where(flat, 1.0, scale)
                gram = n * spread[:-1, :-1] / np.outer(safe, safe)
                cross = n * spread[:-1, -1] / safe
                gram[flat, :] = gram[:, flat] = cross[flat] = 0.0
                coef = np.linalg.solve(gram + alpha * np.eye(size - 1), cross) / safe
                raw = coef / scales
                found.append((n, mean[-1] - coef @ mean[:-1] - raw @ centre, raw.tolist()))
            out = batch[list(keys)].copy()
            out[["n", "intercept", "coefficients"]] = pd.DataFrame(found, index=batch.index, columns=["n", "i", "c"])
            yield out

    return sums.mapInPandas(solve, _schema(sums, keys, "n double, intercept double, coefficients array<double>"))


def linear_value(columns: Column) -> Column:
    """intercept + coefficients * features; NULL when a feature is missing."""
    terms = F.zip_with(columns, F.col("coefficients"), lambda x, c: x * c)
    return F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def score_linear(rows: DataFrame, fitted: DataFrame, columns: list[str], output: str, *keys: str) -> DataFrame:
    """Join every row with its group's coefficients and add the linear value as ``output``."""
    joined = rows.join(fitted.select(*keys, "intercept", "coefficients"), list(keys), "left")
    return joined.withColumn(output, linear_value(features_array(columns))).drop("intercept", "coefficients")


def probability(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def standardisation(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, centre array, scale array) with scale 1 for constant features."""
    parts = [(F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}")) for i, c in enumerate(columns)]
    stats = rows.groupBy(*keys).agg(*[column for pair in parts for column in pair])
    scale = [F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0)) for i in range(len(columns))]
    return stats.select(
        *keys, F.array(*[F.col(f"_m{i}") for i in range(len(columns))]).alias("centre"), F.array(*scale).alias("scale")
    )


def fit_logistic(
    rows: DataFrame,
    columns: list[str],
    label: str,
    *keys: str,
    weight: str | None = None,
    strength: float = 1.0,
    steps: int = MAX_STEPS,
) -> DataFrame:
    """(keys, intercept, coefficients, converged) of L2 logistic regressions on standardised features.

    Newton steps on weighted moments; ``strength`` is the inverse penalty. The small coefficient
    table is settled after each step, so lineage stays short and a lost executor costs one step.
    Curvature has a floor, which damps the steps of groups whose classes are separable and leaves
    the gradient as it is. ``converged`` says whether the last step was below the tolerance.
    """
    size = len(columns)
    groups = settle(standardisation(rows, columns, *keys).withColumn("_g", F.monotonically_increasing_id()))
    base = rows.select(
        *keys,
        features_array(columns).alias("_raw"),
        F.col(label).cast("double").alias("_y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_sw"),
    ).join(groups, list(keys))
    centred = F.zip_with("_raw", "centre", lambda x, m: x - m)
    base = settle(base.select("_g", F.zip_with(centred, F.col("scale"), lambda x, s: x / s).alias("_z"), "_y", "_sw"))

    zero = F.array(*[F.lit(0.0)] * size)
    current = groups.select("_g", F.lit(0.0).alias("intercept"), zero.alias("coefficients"), F.lit(1.0).alias("moved"))

    def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for total, products, bias, coef in zip(
                batch["total"], batch["products"], batch["intercept"], batch["coefficients"]
            ):
                coef = np.asarray(coef, dtype=float)
                mean, square = unpack(np.asarray(products, dtype=float), size + 1)
                # Design with a leading constant; the last variable is the working residual.
                hessian = np.empty((size + 1, size + 1))
                hessian[0, 0], hessian[0, 1:], hessian[1:, 0] = total, total * mean[:-1], total * mean[:-1]
                hessian[1:, 1:] = total * square[:-1, :-1] + np.eye(size) / strength
                gradient = np.concatenate([[total * mean[-1]], total * square[:-1, -1] - coef / strength])
                move = np.linalg.solve(hessian, gradient)
                found.append((bias + move[0], (coef + move[1:]).tolist(), float(np.abs(move).max())))
            out = batch[["_g"]].copy()
            out[["intercept", "coefficients", "moved"]] = pd.DataFrame(found, index=batch.index, columns=["i", "c", "m"])
            yield out

    shape = "_g long, intercept double, coefficients array<double>, moved double"
    for _ in range(steps):
        parts = base.join(current, "_g").mapInArrow(working_moments, "_g long, total double, products array<double>")
        sums = parts.groupBy("_g").agg(
            F.sum("total").alias("total"),
            vector_to_array(Summarizer.mean(array_to_vector(F.col("products")), F.col("total"))).alias("products"),
        )
        current = settle(sums.join(current.drop("moved"), "_g").mapInPandas(newton, shape))
        if (current.agg(F.max("moved")).first()[0] or 0.0) < STEP_TOLERANCE:
            break

    raw = F.zip_with("coefficients", "scale", lambda c, s: c / s)
    shift = F.aggregate(F.zip_with(raw, F.col("centre"), lambda c, m: c * m), F.lit(0.0), lambda a, b: a + b)
    return current.join(groups, "_g").select(
        *keys,
        (F.col("intercept") - shift).alias("intercept"),
        raw.alias("coefficients"),
        (F.col("moved") < STEP_TOLERANCE).alias("converged"),
    )


def score_by_manifest(rows: DataFrame, models: DataFrame, output: str, all_columns: list[str], key: str = "ticker") -> DataFrame:
    """Score rows with per-key models that each use their own ``columns``; one join for all keys.

    ``models`` has (key, columns, intercept, coefficients). A missing needed feature gives NULL.
    """
    lookup = F.create_map(*[part for c in all_columns for part in (F.lit(c), F.col(f"`{c}`").cast("double"))])
    joined = rows.join(models.select(key, "columns", "intercept", "coefficients"), key, "left")
    used = F.transform("columns", lambda c: F.element_at(lookup, c))
    return joined.withColumn(output, linear_value(used)).drop("columns", "intercept", "coefficients")


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
