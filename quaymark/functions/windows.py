"""Row-count window expressions with warm-up guards.

A group is one instrument's calendar. Every bar table holds one row per (instrument, date), so a
group is bounded by the number of trading days however many ticks lie behind it.
"""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def calendar(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(spec: WindowSpec, rows: int) -> WindowSpec:
    return spec.rowsBetween(-(rows - 1), 0)


def change(value: Column, rows: int, spec: WindowSpec) -> Column:
    """Relative change over ``rows`` rows; NULL at the start and for a zero base."""
    return F.try_divide(value, F.lag(value, rows).over(spec)) - F.lit(1.0)


def step(value: Column, spec: WindowSpec) -> Column:
    return value - F.lag(value, 1).over(spec)


def rolling_mean(value: Column, rows: int, spec: WindowSpec) -> Column:
    frame = trailing(spec, rows)
    return F.when(F.count(value).over(frame) >= rows, F.avg(value).over(frame))


def rolling_std(value: Column, rows: int, spec: WindowSpec) -> Column:
    frame = trailing(spec, rows)
    return F.when(F.count(value).over(frame) >= rows, F.stddev_samp(value).over(frame))


def zscore(value: Column, rows: int, spec: WindowSpec) -> Column:
    return F.try_divide(value - rolling_mean(value, rows, spec), rolling_std(value, rows, spec))
