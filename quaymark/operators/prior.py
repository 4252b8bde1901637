"""Weighted medians of one history as many as-of days saw it, without pairing days with history.

A value's weight halves with its age, so two as-of days differ by one factor in all weights: 2^(date / half-life) can be
summed up once. Values are numbered by size and by the day on which they became known; both numbers are cut into about
root-n stretches, value buckets and date blocks. A table of that grid holds the weight of every bucket that became known
before each block. An as-of day then descends: whole blocks from the grid, the rest of its own block row by row, the
bucket in which half of the weight is reached, and in that bucket the value. That is about root-n rows for each of
the three steps, and sums only grow, so no digits are lost in differences.

A history is one market's calendar (a row per day), numbered in one window.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config
from quaymark.session import settle


def _power(date: Column, base: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), F.datediff(date, base).cast("double") / F.lit(half_life))


def indexed(history: DataFrame, *keys: str, known: str, half_life: float = config.RECENCY_HALF_LIFE_DAYS) -> DataFrame:
    """``history`` (keys, date, value) with numbers by value and by ``known`` day, bucket, block and undated weight ``mass``."""
    whole = Window.partitionBy(*keys)
    rows = history.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_base": F.min("date").over(whole),
            "place": F.row_number().over(whole.orderBy(known, "date")) - 1,
            "size_rank": F.row_number().over(whole.orderBy("value", "date")) - 1,
        }
    )
    width = F.ceil(F.sqrt("_n")).cast("int")
    return rows.select(
        *keys, "date", "value", F.col(known).alias("known"), "place", "size_rank", "_base", width.alias("width"),
        F.floor(F.col("size_rank") / width).cast("int").alias("bucket"), F.floor(F.col("place") / width).cast("int").alias("block"),
        _power(F.col("date"), F.col("_base"), half_life).alias("mass"),
    )


def grid(index: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, bucket, mass, n, all): what of a bucket became known before a block, up to one block past the end."""
    cells = index.groupBy(*keys, "block", "bucket").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
    last = index.groupBy(*keys).agg(F.max("block").alias("_last"))
    buckets = index.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("all")).join(last, list(keys))
    places = buckets.select(*keys, "bucket", "all", F.explode(F.sequence(F.lit(0), F.col("_last") + 1)).alias("block"))
    before = Window.partitionBy(*keys, "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    filled = places.join(cells, [*keys, "block", "bucket"], "left")
    zero = lambda c, v: F.coalesce(F.sum(c).over(before), F.lit(v))
    return filled.select(*keys, "block", "bucket", "all", zero("mass", 0.0).alias("mass"), zero("n", 0).alias("n"))


def as_of_medians(
    days: DataFrame, history: DataFrame, *keys: str, known: str, strictly: bool, unknown_too: bool = False,
    half_life: float = config.RECENCY_HALF_LIFE_DAYS,
) -> DataFrame:
    """(keys, as_of, market_median): the weighted median of values ``known`` before (or on, unless ``strictly``) each day.

    With ``unknown_too`` later values count as well, with the weight of age 0. Days that see nothing have no row.
    """
    index = settle(indexed(history, *keys, known=known, half_life=half_life))
    table = settle(grid(index, *keys))
    # How many values each day sees: one pass over the union of both calendars.
    late = F.lit(0 if strictly else 2)
    both = days.select(*keys, F.col("as_of").alias("_day"), late.alias("_turn"), F.lit(0).alias("_one")).unionByName(
        index.select(*keys, F.col("known").alias("_day"), F.lit(1).alias("_turn"), F.lit(1).alias("_one"))
    )
    so_far = Window.partitionBy(*keys).orderBy("_day", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    facts = index.groupBy(*keys).agg(F.first("width").alias("width"), F.first("_base").alias("_base"))
    asked = both.withColumn("seen", F.sum("_one").over(so_far)).where(F.col("_turn") != 1).join(facts, list(keys))
    asked = settle(
        asked.select(
            *keys, F.col("_day").alias("as_of"), "seen", F.floor(F.col("seen") / F.col("width")).cast("int").alias("block"),
            (F.lit(1.0) / _power(F.col("_day"), F.col("_base"), half_life)).alias("factor"),
        )
    )
    query = [*keys, "as_of"]
    blocks = asked.join(table, [*keys, "block"]).select(*query, "factor", "bucket", "all", "mass", "n")
    started = index.select(*keys, "block", "bucket", "place", "mass")
    rest = asked.join(started, [*keys, "block"]).where(F.col("place") < F.col("seen")).select(
        *query, "factor", "bucket", F.lit(0).cast("long").alias("all"), "mass", F.lit(1).cast("long").alias("n")
    )
    later = (F.sum("all") - F.sum("n")).cast("double") if unknown_too else F.lit(0.0)
    weights = blocks.unionByName(rest).groupBy(*query, "bucket").agg(
        (F.first("factor") * F.sum("mass") + later).alias("weight")
    )
    along = Window.partitionBy(*query).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = weights.withColumns({"upto": F.sum("weight").over(along), "half": F.sum("weight").over(Window.partitionBy(*query)) / 2})
    met = (
        summed.where((F.col("weight") > 0) & (F.col("upto") >= F.col("half")))
        .groupBy(*query)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("weight")).alias("before"), "half")).alias("_b"))
        .select(*query, "_b.*")
        .join(asked.select(*query, "seen", "factor"), query)
    )
    inside = met.join(index.select(*keys, "bucket", "value", "size_rank", "place", "mass"), [*keys, "bucket"])
    weight = F.when(F.col("place") < F.col("seen"), F.col("factor") * F.col("mass")).otherwise(F.lit(1.0 if unknown_too else 0.0))
    ranked = inside.withColumn("_w", weight).where("_w > 0")
    up = Window.partitionBy(*query).orderBy("size_rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_upto", F.col("before") + F.sum("_w").over(up))
    # Sums by bucket and by row may differ in the last digit: then it is the bucket's last value.
    return ranked.groupBy(*query).agg(
        F.coalesce(F.min(F.when(F.col("_upto") >= F.col("half"), F.col("value"))), F.max("value")).alias("market_median")
    )
