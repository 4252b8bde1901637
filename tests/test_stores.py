"""Stores read back: versions of bars, months pruned by plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaymark.session import work_path
from quaymark.sources import articles, versions


def _bars(spark, closes):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c)) for t, n, c in closes for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def _read(frame):
    return {r["ticker"]: (r["n"], r["c"]) for r in frame.groupBy("ticker").agg(F.count("*").alias("n"), F.max("close").alias("c")).collect()}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_versions_of_bars(spark):
    path = work_path(spark, "versions")
    assert versions.latest(spark, path) == 0
    assert versions.upsert(spark, path, _bars(spark, [("001", 30, 1), ("B", 30, 1), (None, 2, 1)])) == 1
    pinned = versions.open_version(spark, path, 1)
    assert _read(pinned) == {"001": (30, 1.0), "B": (30, 1.0)}
    # 001 shrank and is refused, B is replaced, C is new
    assert versions.upsert(spark, path, _bars(spark, [("001", 3, 2), ("B", 31, 2), ("C", 1, 2)])) == 2
    assert _read(versions.open_version(spark, path)) == {"001": (30, 1.0), "B": (31, 2.0), "C": (1, 2.0)}
    assert _read(pinned) == _read(versions.open_version(spark, path, 1)) == {"001": (30, 1.0), "B": (30, 1.0)}
    assert versions.upsert(spark, path, _bars(spark, [("001", 3, 3)])) == 2  # nothing taken, nothing written
    assert "dynamicpruning" in _plan(versions.open_version(spark, path))


def test_a_failed_write_leaves_the_version_readable(spark):
    path = work_path(spark, "versions")
    versions.upsert(spark, path, _bars(spark, [("A", 30, 1), ("B", 30, 1)]))
    # The rows of B fail after those of A may have been written.
    broken = _bars(spark, [("A", 40, 2), ("B", 40, 2)]).withColumn(
        "close", F.when((F.col("ticker") == "B") & (F.dayofmonth("date") == 9), F.raise_error("lost").cast("double")).otherwise(F.col("close"))
    )
    with pytest.raises(Exception, match="lost"):
        versions.upsert(spark, path, broken)
    assert versions.latest(spark, path) == 1
    assert _read(versions.open_version(spark, path)) == {"A": (30, 1.0), "B": (30, 1.0)}
    assert versions.upsert(spark, path, _bars(spark, [("A", 40, 2)])) == 2
    assert _read(versions.open_version(spark, path)) == {"A": (40, 2.0), "B": (30, 1.0)}


def test_listed_months_prune_while_running(spark):
    rows = spark.range(400).select("id", F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("date"))
    path = work_path(spark, "months")
    store = articles.refresh_scored(spark, articles.with_month(rows), path, dt.date(2021, 2, 1), lambda todo: todo)
    months = spark.createDataFrame([(2020, 2, 5), (2020, 12, 9), (2020, 2, 7)], "year int, month int, x int").where("x > 4")
    listed = articles.of_months(store, months)
    assert "dynamicpruning" in _plan(listed)
    assert sorted(r["id"] for r in listed.collect()) == [*range(31, 60), *range(335, 366)]
    assert "PartitionFilters: [isnotnull(year" in _plan(articles.recent_months(store, dt.date(2021, 1, 5)))
