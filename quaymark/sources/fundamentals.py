"""Flat fundamentals table out of the provider's sparse key-value snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_fundamentals(snapshots: DataFrame) -> DataFrame:
    """From (symbol, info map<string,string>) to typed nullable columns."""

    def number(key: str):
        return F.expr("info").getItem(key).cast("double")

    def truthy(value):
        return F.nullif(value, F.lit(0.0))

    index_label = F.when(F.col("symbol").startswith("^"), F.lit("Index, not a company"))
    return snapshots.select(
        "symbol",
        number("trailingPE").alias("trailing_pe"),
        number("forwardPE").alias("forward_pe"),
        (truthy(number("marketCap")) / 1e9).alias("market_cap_billions"),
        number("priceToBook").alias("price_to_book"),
        truthy(number("dividendYield")).alias("dividend_yield_pct"),
        number("beta").alias("beta"),
        (number("profitMargins") * 100).alias("profit_margin_pct"),
        (number("revenueGrowth") * 100).alias("revenue_growth_pct"),
        F.coalesce(F.nullif(F.col("info").getItem("sector"), F.lit("")), index_label).alias("sector"),
        number("fiftyTwoWeekLow").alias("52w_low"),
        number("fiftyTwoWeekHigh").alias("52w_high"),
    )
