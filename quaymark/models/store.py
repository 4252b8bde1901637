"""Model store: coefficient tables and the column manifest of the shipped models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def required_columns(manifest: DataFrame) -> DataFrame:
    """(ticker, columns): the sorted union of both tasks' columns."""
    return manifest.groupBy("ticker").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns")
    )


def save(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").partitionBy("task").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
