"""Report sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A report as Parquet, CSV (with header) or JSON lines (NULL fields kept)."""
    writer = report.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.format(fmt).save(path)


def as_json(report: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per row; NULL fields are written as null."""
    body = [name for name in report.columns if name not in keys]
    return report.select(*keys, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("document"))
