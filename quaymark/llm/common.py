"""Small helpers of the operators: tables, hashed draws and settled intermediate tables."""

import gc

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.session import settle

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ticket(seed: str, key: Column, digits: int = 12) -> Column:
    """A repeatable draw from 0 to 16^digits - 1 for each key, the same on every engine that has md5."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def id_crc(name: str = "doc_id") -> Column:
    """crc32 of the id as text, the fold key of the classifiers."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def told_apart(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").isEmpty()


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of each class: the least doc_id, null last; rows that share a doc_id are told apart.

    ``classes`` gives ``doc_id, class`` for rows of ``doc_id, text``. It is asked about row numbers in place of ids;
    the numbered rows are settled, so that a number stays with its row when tasks run again.
    """
    ids, texts = F.col("row.doc_id"), F.col("row.text")
    rows = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    found = classes(rows.select(F.col("number").alias("doc_id"), texts.alias("text")))
    own = found.join(rows.select(F.col("number").alias("doc_id"), ids.isNull().alias("no_id"), ids.alias("id")), "doc_id")
    first = own.groupBy("class").agg(F.min(F.struct("no_id", "id", "doc_id")).alias("first"))
    kept = settle(first.select(F.col("first.doc_id").alias("number")))
    return rows.join(kept.hint("merge"), "number", "left_semi").select("row.*")


def release(spark: SparkSession) -> None:
    """Between rounds: lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


__all__ = ["SPACE", "WORD", "id_crc", "one_of_each", "release", "settle", "table", "ticket", "told_apart", "whole_text"]
