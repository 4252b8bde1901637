"""Stores written and read again inside a query: scored months, and bars in versions."""

import datetime as dt

from pyspark.sql import functions as F

from catalogue import news
from catalogue.bars import BAR_SPEC
from catalogue.common import ARTICLES, BARS, FLAGGED, SCORED, emit, portable, query
from quaymark.session import work_path
from quaymark.sources import articles, derived, versions

OPEN_MONTH = dt.date(1998, 6, 15)


def _store(spark, folder):
    """The month store after two refreshes: history up to the open month, then every article."""
    rows = articles.with_month(news.scored(spark, folder).select("doc_id", "date", "sentiment"))
    path = work_path(spark, "scored-months")
    for turn, part in enumerate([rows.where(F.col("date") <= OPEN_MONTH), rows], 1):
        store = articles.refresh_scored(spark, part, path, OPEN_MONTH, lambda todo: todo.withColumn("turn", F.lit(turn)))
    return store


def _monthly(rows):
    return portable(
        rows.groupBy("year", "month", "turn").agg(
            F.count(F.lit(1)).alias("n"), F.count("sentiment").alias("n_scored"), F.sum("sentiment").alias("total")
        )
    )


def stored_months(spark, folder):
    """Months scored by the first refresh are kept, the open month is scored again."""
    return _monthly(_store(spark, folder))


def stored_month_range(spark, folder):
    return _monthly(articles.month_range(_store(spark, folder), "1996-11", "1998-07"))


def stored_recent_months(spark, folder):
    return _monthly(articles.recent_months(_store(spark, folder), dt.date(1998, 7, 3)))


def busy_months(spark, folder):
    """Months in which the whole market traded more than 1.02 times its monthly mean of orders."""
    dates = derived.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    counts = articles.with_month(dates).groupBy("year", "month").agg(F.count(F.lit(1)).alias("orders"))
    mean = counts.agg((F.avg("orders") * 1.02).alias("least"))
    return counts.join(mean, F.col("orders") > F.col("least")).select("year", "month")


def stored_busy_months(spark, folder):
    return _monthly(articles.of_months(_store(spark, folder), busy_months(spark, folder)))


def versioned_bars(spark, folder):
    """Two versions of the store of bars, read back side by side: one segment of the second is refused by the guard."""
    path = work_path(spark, "bar-versions")
    cached = derived.daily_bars(spark, folder)
    broken = (F.col("ticker") == "BUILDING") & (F.year("date") > 1992)
    incoming = cached.where(~broken).withColumn("volume", F.col("volume") + 1)
    numbers = [versions.upsert(spark, path, cached), versions.upsert(spark, path, incoming)]
    columns = ["version", *cached.columns]
    first, second = (versions.open_version(spark, path, n).withColumn("version", F.lit(n)).select(*columns) for n in numbers)
    return portable(first.unionByName(second))


MONTHLY = (
    "monthly AS (SELECT year(date) AS year, month(date) AS month, CASE WHEN year(date) * 12 + month(date) >= 1998 * 12 + 6 "
    "THEN 2 ELSE 1 END AS turn, count(*) AS n, count(sentiment) AS n_scored, sum(sentiment) AS total FROM scored GROUP BY ALL)"
)
BUSY = (
    "counts AS (SELECT year(CAST(o_orderdate AS DATE)) AS year, month(CAST(o_orderdate AS DATE)) AS month, count(*) AS orders "
    "FROM orders GROUP BY ALL), busy AS (SELECT year, month FROM counts WHERE orders > (SELECT avg(orders) * 1.02 FROM counts))"
)
SPEC = "year:i month:i turn:i n:i n_scored:i total:f"

QUERIES = {
    "stored_months": stored_months,
    "stored_month_range": stored_month_range,
    "stored_recent_months": stored_recent_months,
    "stored_busy_months": stored_busy_months,
    "versioned_bars": versioned_bars,
}

_CTES = [ARTICLES, FLAGGED, SCORED, MONTHLY]
ORACLES = {
    "stored_months": query(*_CTES, emit("monthly", SPEC)),
    "stored_month_range": query(*_CTES, emit("monthly", SPEC) + " WHERE year * 12 + month BETWEEN 1996 * 12 + 11 AND 1998 * 12 + 7"),
    "stored_recent_months": query(*_CTES, emit("monthly", SPEC) + " WHERE year = 1998 AND month IN (6, 7)"),
    "stored_busy_months": query(*_CTES, BUSY, emit("monthly", SPEC) + " WHERE (year, month) IN (SELECT (year, month) FROM busy)"),
    "versioned_bars": query(
        BARS,
        "fresh AS (SELECT * REPLACE (volume + 1 AS volume) FROM bars WHERE NOT (ticker = 'BUILDING' AND year(date) > 1992))",
        "c AS (SELECT ticker, count(*) AS n FROM bars GROUP BY 1), f AS (SELECT ticker, count(*) AS n FROM fresh GROUP BY 1)",
        "keep AS (SELECT c.ticker FROM c LEFT JOIN f ON c.ticker = f.ticker WHERE f.n IS NULL OR (c.n > 20 AND f.n < c.n / 2))",
        "m AS (SELECT 1 AS version, * FROM bars UNION ALL SELECT 2, * FROM bars WHERE ticker IN (SELECT ticker FROM keep) "
        "UNION ALL SELECT 2, * FROM fresh WHERE ticker NOT IN (SELECT ticker FROM keep))",
        emit("m", "version:i " + BAR_SPEC),
    ),
}
