"""News archive: nested JSON to slim articles, and the month-partitioned store of scored articles."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark import schemas


def organizations(keywords: Column) -> Column:
    """``"; "``-joined values of the organization tags; empty for NULL keywords."""
    tags = F.filter(keywords, lambda k: F.coalesce(k["name"] == "organizations", F.lit(False)))
    return F.coalesce(F.array_join(F.transform(tags, lambda k: k["value"]), "; "), F.lit(""))


def slim_articles(archive: DataFrame, column: str = "json") -> DataFrame:
    """One row per article from archive documents held as JSON text in ``column``."""

    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    docs = archive.select(
        F.explode(F.from_json(column, schemas.ARCHIVE_MONTH)["response"]["docs"]).alias("doc")
    )
    return docs.select(
        F.col("doc.pub_date").alias("pub_date"),
        text(F.col("doc.section_name")).alias("section_name"),
        text(F.col("doc.news_desk")).alias("news_desk"),
        text(F.col("doc.headline.main")).alias("headline"),
        text(F.col("doc.abstract")).alias("abstract"),
        organizations(F.col("doc.keywords")).alias("organizations"),
    )


def published_on(pub_date: Column) -> Column:
    """Calendar day of an ISO-8601 time as written, whatever its precision and zone suffix."""
    return F.try_to_date(F.substring(pub_date, 1, 10))


def with_month(articles: DataFrame, date: str = "date") -> DataFrame:
    return articles.withColumns({"year": F.year(date), "month": F.month(date)})


def month_range(articles: DataFrame, start: str, end: str) -> DataFrame:
    """Articles of the closed month range ``YYYY-MM``..``YYYY-MM``; prunes month partitions."""

    def ordinal(text: str) -> int:
        year, month = text.split("-")
        return int(year) * 12 + int(month)

    position = F.col("year") * 12 + F.col("month")
    # The bound on the partition column itself keeps pruning simple for every file source.
    years = F.col("year").between(int(start[:4]), int(end[:4]))
    return articles.where(years & position.between(ordinal(start), ordinal(end)))


def recent_months(articles: DataFrame, today: dt.date) -> DataFrame:
    """The current and the previous month, enough for inference."""
    previous = today.replace(day=1) - dt.timedelta(days=1)
    return month_range(articles, previous.strftime("%Y-%m"), today.strftime("%Y-%m"))


def of_months(store: DataFrame, months: DataFrame) -> DataFrame:
    """Articles of the months listed in ``months`` (``year, month``); other partitions are pruned while the query runs."""
    return store.join(months.select("year", "month").distinct(), ["year", "month"], "left_semi")


def months_to_score(articles: DataFrame, scored: DataFrame | None, current: dt.date) -> DataFrame:
    """Articles of months not scored yet, plus the month still open."""
    if scored is None:
        return articles
    done = scored.select("year", "month").distinct().where(
        ~((F.col("year") == current.year) & (F.col("month") == current.month))
    )
    return articles.join(done, ["year", "month"], "left_anti")


def refresh_scored(
    spark: SparkSession,
    articles: DataFrame,
    path: str,
    current: dt.date,
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Score what is missing and write it month by month; returns the whole store."""
    try:
        scored = spark.read.parquet(path)
    except Exception as error:  # first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        scored = None
    fresh = score(months_to_score(articles, scored, current))
    (
        fresh.hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )
    return spark.read.parquet(path)
