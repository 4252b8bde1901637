"""Dumb baselines every model has to beat, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Probability given to the class persistence repeats, and to the other one.
SURE, UNSURE = 0.98, 0.02


def persistence_return(feature: str = "ret_1d") -> Column:
    return F.col(feature)


def persistence_probability(feature: str = "ret_1d") -> Column:
    return F.when(F.col(feature) > 0, F.lit(SURE)).otherwise(F.lit(UNSURE))


def zero_return() -> Column:
    return F.lit(0.0)


def majority_class(train: DataFrame, *keys: str, label: str = "target_direction") -> DataFrame:
    """(keys, majority): the most frequent class of the training rows, the smaller one on a tie."""
    counts = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("majority"))
