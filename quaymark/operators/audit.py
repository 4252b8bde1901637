"""Leakage audit: features of truncated history must equal the features of the full history."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import config, schemas
from quaymark.operators import asof, macro, news
from quaymark.operators.features import own_features
from quaymark.operators.splits import numbered
from quaymark.session import settle


def _with_cuts(bars: DataFrame) -> DataFrame:
    """Numbered bars with the array of their instrument's cut positions."""
    cuts = F.array_distinct(
        F.array(*[F.floor(F.col("_rows") * F.lit(share)) for share in config.LEAK_CUTOFFS])
    )
    return numbered(bars, "ticker").withColumn("_cuts", F.filter(cuts, lambda c: c >= config.LEAK_MIN_ROWS))


def cut_days(bars: DataFrame) -> DataFrame:
    """(ticker, day): the last day of every truncated prefix."""
    rows = _with_cuts(bars)
    return rows.where(F.array_contains("_cuts", F.col("_row") + 1)).select("ticker", F.col("date").alias("day"))


def leaked(full: Column, truncated: Column) -> Column:
    """Different beyond the tolerance; a value against NULL counts as different."""
    both = full.isNotNull() & truncated.isNotNull()
    return F.when(both, F.abs(full - truncated) > config.LEAK_TOLERANCE).otherwise(
        full.isNotNull() | truncated.isNotNull()
    )


def _report(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, n_cutoffs, n_checked, n_leaks, leaking columns) of joined ``f_*`` and ``t_*`` values."""
    bad = F.array_compact(
        F.array(*[F.when(leaked(F.col(f"f_{c}"), F.col(f"t_{c}")), F.lit(c)) for c in columns])
    )
    return pairs.withColumn("_bad", bad).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_cutoffs"),
        (F.count(F.lit(1)) * len(columns)).alias("n_checked"),
        F.sum(F.size("_bad")).alias("n_leaks"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_bad")))), ",").alias("leaking"),
    )


def _renamed(frame: DataFrame, prefix: str, columns: list[str], *keys: str) -> DataFrame:
    return frame.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _last_known(frame: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Each column's newest value per group: what an as-of read at the end of the group sees."""
    return frame.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns]
    )


def audit_own(bars: DataFrame, features=own_features, columns: list[str] = schemas.OWN_FEATURES) -> DataFrame:
    """Recompute own features on every prefix (one instrument-prefix pair is one group)."""
    prefixes = _with_cuts(bars).withColumn("cut", F.explode(F.filter("_cuts", lambda c: F.col("_row") < c)))
    rebuilt = features(prefixes, "cut")
    last = rebuilt.groupBy("ticker", "cut").agg(F.max_by(F.struct("date", *columns), "date").alias("_l"))
    truncated = last.select("ticker", "_l.*")
    full = _renamed(features(bars), "f", columns, "ticker", "date")
    return _report(_renamed(truncated, "t", columns, "ticker", "date").join(full, ["ticker", "date"], "left"), columns)


def segments(rows: DataFrame, days: DataFrame, *keys: str, memory: int = 0) -> tuple[DataFrame, DataFrame]:
    """History cut at every ``day``: (rows with ``segment``, the days of the calendar with theirs).

    Segment i holds what became known after the (i-1)th day and up to the ith. It also gets the last ``memory`` rows of
    each group of ``keys`` from before, which is all the state that features of bounded look-back need. So a prefix is told by
    its last segment and what earlier ones left: no row is copied once for every later day.
    """
    count = days.count()
    calendar = rows.select("date", F.lit(0).alias("_cut")).unionByName(days.select(F.col("day").alias("date"), F.lit(1).alias("_cut")))
    marks = calendar.groupBy("date").agg(F.max("_cut").alias("_cut"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    spans = settle(marks.select("date", (F.coalesce(F.sum("_cut").over(before), F.lit(0)) + 1).alias("segment")))
    placed = rows.join(spans, "date").where(F.col("segment") <= count)
    if not memory:
        return placed, spans
    counted = settle(placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))))
    sizes = counted.groupBy(*keys, "segment").agg(F.count("*").alias("_n"))
    grid = rows.select(*keys).distinct().withColumn("segment", F.explode(F.sequence(F.lit(1), F.lit(count)).cast("array<bigint>")))
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = grid.join(sizes, [*keys, "segment"], "left").withColumn("_end", F.sum("_n").over(earlier)).where(F.col("_end") > 0)
    first = F.greatest(F.lit(1), F.col("_end") - memory + 1)
    wanted = ends.select(*keys, "segment", F.explode(F.sequence(first.cast("int"), F.col("_end").cast("int"))).alias("_r"))
    carried = wanted.join(counted.drop("segment"), [*keys, "_r"])
    return counted.drop("_r").unionByName(carried.drop("_r")), spans


def _as_of_cuts(rebuilt: DataFrame, spans: DataFrame, days: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, day, columns): newest values at the end of each segment, carried over the segments before it."""
    own = rebuilt.withColumnRenamed("segment", "_segment").join(spans, "date").where(F.col("_segment") == F.col("segment"))
    newest = _last_known(own, columns, *keys, "segment")
    ends = days.select(F.col("day").alias("date")).join(spans, "date").select("segment", F.col("date").alias("day"))
    if not keys:
        grid = ends
    else:  # every group at every cut day
        each = F.explode(F.sequence(F.lit(1), F.lit(days.count())).cast("array<bigint>")).alias("segment")
        grid = rebuilt.select(*keys).distinct().select(*keys, each).join(ends, "segment")
    so_far = Window.partitionBy(*keys).orderBy("segment") if keys else Window.orderBy("segment")  # a row for each day
    carried = {c: F.last(c, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    return grid.join(newest, [*keys, "segment"], "left").withColumns(carried).select(*keys, "day", *columns)


def audit_macro(bars: DataFrame, macro_bars: DataFrame, features=macro.macro_features) -> DataFrame:
    """Aligned cross-market features at each cut day, from all series truncated to that day."""
    columns = schemas.MACRO_FEATURES
    cuts = settle(cut_days(bars))
    full = asof.align_shared(
        cuts.withColumnRenamed("day", "date"), features(macro_bars), columns
    ).withColumnRenamed("date", "day")
    days = cuts.select("day").distinct()
    known, spans = segments(macro_bars, days, "series", memory=macro.Z_ROWS + 1)
    rebuilt = _as_of_cuts(features(known, "segment"), spans, days, columns)
    pairs = _renamed(full, "f", columns, "ticker", "day").join(_renamed(rebuilt, "t", columns, "day"), "day", "left")
    return _report(pairs, columns)


def audit_news(
    bars: DataFrame, scored: DataFrame, tickers: list[str], covered: list[str] | None = None, features=news.ticker_news
) -> DataFrame:
    """Aligned news features at each cut day, from the articles published up to that day."""
    columns = schemas.NEWS_FEATURES
    cuts = settle(cut_days(bars))
    slim = scored.select("date", "sentiment", "business_ctx", "tickers")
    full = asof.align_per_entity(
        cuts.withColumnRenamed("day", "date"), features(news.daily_news(slim), tickers, covered), columns
    ).withColumnRenamed("date", "day")
    days = cuts.select("day").distinct()
    known, spans = segments(slim, days)
    rebuilt = features(news.daily_news(known, "segment"), tickers, covered, by=("segment",))
    truncated = _as_of_cuts(rebuilt, spans, days, columns, "ticker")
    pairs = _renamed(full, "f", columns, "ticker", "day").join(
        _renamed(truncated, "t", columns, "ticker", "day"), ["ticker", "day"], "left"
    )
    return _report(pairs, columns)
