"""Backward as-of alignment: each column carries its last known value onto another calendar."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_shared(rows: DataFrame, values: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Left-join date-level ``values`` onto ``rows`` as of each row's date.

    The carry runs once over the union of the two calendars, not once per instrument. That union
    holds one row per day, so its single ordered pass is bounded by the length of history.
    """
    marked = values.select(date, *columns).unionByName(
        rows.select(date).distinct(), allowMissingColumns=True
    )
    merged = marked.groupBy(date).agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in columns])
    so_far = f"ORDER BY `{date}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    carried = merged.selectExpr(f"`{date}`", *[f"last(`{c}`, true) OVER ({so_far}) AS `{c}`" for c in columns])
    return rows.join(carried, date, "left")


def align_per_entity(
    rows: DataFrame, values: DataFrame, columns: list[str], key: str = "ticker", date: str = "date"
) -> DataFrame:
    """The same per entity: union both sides, carry over the entity's calendar, keep the rows.

    One exchange by ``key`` and no join, however far apart the two calendars are.
    """
    incoming = values.select(key, date, *columns).withColumn("_is_row", F.lit(False))
    both = rows.withColumn("_is_row", F.lit(True)).unionByName(incoming, allowMissingColumns=True)
    # Values of the same day sort before the row that may use them (false < true).
    so_far = f"PARTITION BY `{key}` ORDER BY `{date}`, _is_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    carried = both.withColumns({c: F.expr(f"last(`{c}`, true) OVER ({so_far})") for c in columns})
    return carried.where("_is_row").drop("_is_row")
