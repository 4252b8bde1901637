"""Sample weights."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quaymark import config


def recency_by_rows(*keys: str, order: str = "date", half_life: float = config.RECENCY_HALF_LIFE_ROWS) -> Column:
    """1 for the newest row of the group, halved every ``half_life`` rows back."""
    newest_first = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return F.pow(F.lit(0.5), (F.row_number().over(newest_first) - 1) / F.lit(float(half_life)))


def recency_by_days(as_of: Column, date: Column, half_life: float = config.RECENCY_HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.datediff(as_of, date), F.lit(0)).cast("double")
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def balanced_class(label: str, *keys: str) -> Column:
    """n / (2 * n_class) inside each group."""
    group = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, label))
    return group / (F.lit(2.0) * same)
