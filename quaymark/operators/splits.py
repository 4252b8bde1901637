"""Chronological splits and expanding folds as columns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config


def numbered(rows: DataFrame, *keys: str, order: str = "date") -> DataFrame:
    """Add ``_row`` (from 0) and ``_rows`` per group."""
    group = Window.partitionBy(*keys)
    return rows.withColumn("_row", F.row_number().over(group.orderBy(order)) - 1).withColumn(
        "_rows", F.count(F.lit(1)).over(group)
    )


def _label(is_test):
    return F.when(is_test, F.lit("test")).otherwise(F.lit("train"))


def chrono_split(rows: DataFrame, *keys: str, fraction: float = config.TEST_FRACTION) -> DataFrame:
    """The newest max(fraction of n, 30) rows of each group are the test rows."""
    n_test = F.greatest(F.floor(F.col("_rows") * F.lit(fraction)), F.lit(config.MIN_TEST_ROWS))
    return (
        numbered(rows, *keys)
        .withColumn("split", _label(F.col("_row") >= F.col("_rows") - n_test))
        .drop("_row", "_rows")
    )


def share_split(rows: DataFrame, *keys: str, fraction: float = config.TEST_FRACTION) -> DataFrame:
    """Train rows are the oldest floor(n * (1 - fraction)); no minimum."""
    return (
        numbered(rows, *keys)
        .withColumn("split", _label(F.col("_row") >= F.floor(F.col("_rows") * F.lit(1 - fraction))))
        .drop("_row", "_rows")
    )


def day_split(
    rows: DataFrame, *keys: str, fraction: float = config.TEST_FRACTION, min_days: int = config.MIN_TEST_DAYS
) -> DataFrame:
    """Whole days: the newest max(fraction of days, ``min_days``) days of each group are the test days."""
    group = Window.partitionBy(*keys)
    ranked = rows.withColumn("_day", F.dense_rank().over(group.orderBy("date"))).withColumn(
        "_days", F.max("_day").over(group)
    )
    n_test = F.greatest(F.floor(F.col("_days") * F.lit(fraction)), F.lit(min_days))
    return ranked.withColumn("split", _label(F.col("_day") > F.col("_days") - n_test)).drop("_day", "_days")


def expanding_folds(
    rows: DataFrame, *keys: str, folds: int = config.STABILITY_FOLDS, min_rows: int = config.MIN_FOLD_ROWS
) -> DataFrame:
    """One copy of a row per fold it serves, with ``fold`` and ``role``; train is everything earlier.

    Test blocks have floor(n / (folds + 1)) rows and end at the newest row; groups whose blocks
    are shorter than ``min_rows`` have no folds.
    """
    size = F.floor(F.col("_rows") / (folds + 1))
    start = F.col("_rows") - (F.lit(folds) - F.col("fold")) * size
    return (
        numbered(rows, *keys)
        .where(size >= min_rows)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .where(F.col("_row") < start + size)
        .withColumn("role", _label(F.col("_row") >= start))
        .drop("_row", "_rows")
    )


def split_audit(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct days and date range of every split."""
    return rows.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("date").alias("n_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
