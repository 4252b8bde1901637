"""Point estimates of a forward-return sample, all groups in one pass."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config

NAMES = ["mean", "median", "trimmed_mean_10pct", "winsorized_mean_iqr", "recency_weighted_median"]
TRIM_MIN = 10


def point_estimates(samples: DataFrame, *keys: str, value: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, n, mean, median, trimmed mean, winsorised mean, weighted median).

    One exchange by ``keys`` and one sort by value serve ranks, quartiles and cumulative weights.
    A group is one instrument's history at one horizon.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(value)
    v = F.col(value)
    ranked = samples.select(*keys, value, weight).withColumns(
        {
            "_rank": F.row_number().over(ordered) - 1,
            "_weight_so_far": F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.count(v).over(whole),
            "_weight": F.sum(weight).over(whole),
        }
    )

    def quantile(share: float) -> Column:
        """Linear interpolation between the two neighbouring ranks."""
        place = (F.col("_n") - 1) * share
        low = F.max(F.when(F.col("_rank") == F.floor(place), v)).over(whole)
        high = F.max(F.when(F.col("_rank") == F.ceil(place), v)).over(whole)
        return low + (high - low) * (place - F.floor(place))

    ranked = ranked.withColumns({"_q1": quantile(0.25), "_q2": quantile(0.5), "_q3": quantile(0.75)})
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    clipped = F.least(F.greatest(v, F.col("_q1") - reach), F.col("_q3") + reach)
    inner = (
        (F.col("_n") < TRIM_MIN)
        | (F.col("_rank") >= F.floor(F.col("_n") * 0.1)) & (F.col("_rank") < F.floor(F.col("_n") * 0.9))
    )
    return ranked.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.max("_q2").alias("median"),
        F.avg(F.when(inner, v)).alias("trimmed_mean_10pct"),
        F.avg(clipped).alias("winsorized_mean_iqr"),
        F.min(F.when(F.col("_weight_so_far") >= F.col("_weight") / 2, v)).alias("recency_weighted_median"),
    )


def weighted_median(samples: DataFrame, *keys: str, value: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, weighted_median): the smallest value that half of the weight does not exceed."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = samples.select(
        *keys,
        value,
        F.sum(weight).over(so_far).alias("_so_far"),
        F.sum(weight).over(whole).alias("_all"),
    )
    return (
        ranked.where(F.col("_so_far") >= F.col("_all") / 2)
        .groupBy(*keys)
        .agg(F.min(value).alias("weighted_median"))
    )


def shrink(own: Column, market: Column, n: Column, strength: float = config.SHRINKAGE_STRENGTH) -> Column:
    """Blend towards the market by effective sample size; without a market estimate keep ``own``."""
    share = n / (n + F.lit(float(strength)))
    return F.coalesce(share * own + (F.lit(1.0) - share) * market, own)
