"""Exponential smoothing as window sums, without Python.

The recursion y[i] = a*x[i] + (1-a)*y[i-1] is cut into blocks. Inside a block it is a weighted
running sum; what earlier blocks add decays by (1-a)^block, so a few block ends are enough.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


@dataclass(frozen=True)
class Smooth:
    """One smoothed series: ``value`` is smoothed with ``alpha`` and seeded at row ``seed_row``."""

    value: str
    alpha: float
    seed_row: int = 0


def number_rows(df: DataFrame, *keys: str, order: str = "date") -> DataFrame:
    """Add the row number ``_i`` (from 0) and its block ``_b``."""
    spec = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_i", F.row_number().over(spec) - 1).withColumn("_b", F.floor(F.col("_i") / BLOCK))


def block_order(*keys: str):
    """Same order as by date; one sort by (keys, _b, _i) then serves every window of the plan."""
    return Window.partitionBy(*keys).orderBy("_b", "_i")


def _blocks_back(keep: float) -> int:
    return max(1, math.ceil(math.log(1e-17) / (BLOCK * math.log(keep)))) if keep > 0 else 1


def _stays_finite(keep: float) -> bool:
    """Whether ``keep ** -BLOCK`` leaves room for values below 1e100."""
    return keep > 0 and -BLOCK * math.log10(keep) < 200


def _direct(spec: Smooth, *keys: str) -> Column:
    keep = 1.0 - spec.alpha
    rows = 1 if keep <= 0 else math.ceil(math.log(1e-17) / math.log(keep))
    order = block_order(*keys)
    total = F.lit(0.0)
    for back in range(rows):
        row, value = (F.lag(c, back).over(order) if back else F.col(c) for c in ("_i", spec.value))
        share = F.when(row == spec.seed_row, 1.0).when(row > spec.seed_row, spec.alpha).otherwise(0.0)
        total = total + F.coalesce(value * share, F.lit(0.0)) * keep**back
    return F.when(F.col("_i") >= spec.seed_row, total)


def smooth(df: DataFrame, series: dict[str, Smooth], *keys: str) -> DataFrame:
    """Append one column per entry of ``series``. Needs the columns of :func:`number_rows`.

    Where most of the weight is on the newest values, a value fades within one block; such series are direct sums
    of the few rows that still count.
    """
    brief = {name: spec for name, spec in series.items() if not _stays_finite(1.0 - spec.alpha)}
    if brief:
        df = df.withColumns({name: _direct(spec, *keys) for name, spec in brief.items()})
        series = {name: spec for name, spec in series.items() if name not in brief}
        if not series:
            return df
    at = F.col("_i") % BLOCK
    inside = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    passed = {name: f"_in_{name}" for name in series}

    def inner(spec: Smooth) -> Column:
        keep = 1.0 - spec.alpha
        value = F.col(spec.value)
        term = (
            F.when(F.col("_i") < spec.seed_row, F.lit(0.0))
            .when(F.col("_i") == spec.seed_row, value)
            .otherwise(value * spec.alpha)
        )
        return F.pow(F.lit(keep), at) * F.sum(term * F.pow(F.lit(keep), -at)).over(inside)

    def carried(name: str, spec: Smooth) -> Column:
        keep = 1.0 - spec.alpha
        block_end = F.when(at == BLOCK - 1, F.col(passed[name]))
        total = F.lit(0.0)
        for back in range(1, _blocks_back(keep) + 1):
            earlier = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-back, -back)
            total = total + F.coalesce(F.max(block_end).over(earlier), F.lit(0.0)) * keep ** (BLOCK * (back - 1))
        return F.when(F.col("_i") >= spec.seed_row, F.col(passed[name]) + F.pow(F.lit(keep), at + 1) * total)

    df = df.withColumns({passed[name]: inner(spec) for name, spec in series.items()})
    df = df.withColumns({name: carried(name, spec) for name, spec in series.items()})
    return df.drop(*passed.values())
