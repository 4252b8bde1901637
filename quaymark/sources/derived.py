"""Market-shaped inputs derived from the supplied tables (see FIXTURES.md)."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import dates
from quaymark.sources import bars as bar_source

MARKET = "MARKET"
# Brands that stand in for the 17 cross-market series, in order of the series list.
SERIES_NAMES = [
    "VIX", "TNX", "DXY", "OIL", "GOLD", "DJI", "IXIC", "RUT", "HYG",
    "IEF", "QQQ", "IRX", "NIKKEI", "FTSE", "DAX", "BTC", "VXN",
]
BUSINESS_SECTIONS = ["src0", "src1", "src2", "src3", "src4", "src5"]
BUSINESS_DESKS = ["es"]
# Keywords that occur in the supplied prose and tags, one list per market segment.
SEGMENT_KEYWORDS = {
    "AUTOMOBILE": ["src7", "ononst"],
    "BUILDING": ["src12", "attion"],
    "FURNITURE": ["src13; ", "eringedwh"],
    "HOUSEHOLD": ["src14"],
}
OPTIONS_TODAY = dt.date(2001, 12, 20)


# Columns read from the supplied tables; a declared schema saves a pass over the footers.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_returnflag string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_size int, p_retailprice double",
    "documents": "doc_id bigint, text string, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Order prices per market segment and day."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date")
    )
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    ticks = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return bar_source.bars_from_ticks(ticks, "o_totalprice", F.col("o_orderkey"), "ticker", "date")


def market_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The same over all orders: the market index."""
    ticks = table(spark, folder, "orders").select(
        F.lit(MARKET).alias("ticker"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice"
    )
    return bar_source.bars_from_ticks(ticks, "o_totalprice", F.col("o_orderkey"), "ticker", "date")


def all_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Segments and the market index from one pass over the orders."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    owned = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    tickers = F.array_compact(F.array(F.col("c_mktsegment"), F.lit(MARKET)))
    ticks = owned.select("date", "o_orderkey", "o_totalprice", F.explode(tickers).alias("ticker"))
    return bar_source.bars_from_ticks(ticks, "o_totalprice", F.col("o_orderkey"), "ticker", "date")


def macro_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Average unit price per brand and shipping day; brand n plays series n, later brands keep their own name."""
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date")
    )
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    names = F.array(*[F.lit(name) for name in SERIES_NAMES])
    parts = (
        table(spark, folder, "part")
        .select("p_partkey", F.coalesce(F.get(names, brand - 1), F.col("p_brand")).alias("series"))
    )
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("series", "date")
        .agg(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"))
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.TICKS).parquet(f"{folder}/events.parquet").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )


def intraday_bars(spark: SparkSession, folder: str, minutes: int = 60) -> DataFrame:
    return bar_source.session_bars(ticks(spark, folder), "value", "event_id", minutes)


def event_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the same ticks, for the previous-day context."""
    daily = ticks(spark, folder).withColumn("date", F.to_date("ts"))
    return bar_source.bars_from_ticks(daily, "value", dates.event_order(F.col("ts"), F.col("event_id")), "ticker", "date")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as slim articles; the abstract is the whole rest of the text."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.date_add(F.lit(dt.date(1995, 1, 1)), (F.col("doc_id") * 37 % 2400).cast("int")).alias("date"),
        F.col("source").alias("section_name"),
        F.col("lang").alias("news_desk"),
        F.substring("text", 1, 80).alias("headline"),
        F.expr("substring(text, 81)").alias("abstract"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(""))
        .otherwise(F.concat_ws("; ", "source", "lang"))
        .alias("organizations"),
    )


def archive_json(spark: SparkSession, folder: str) -> DataFrame:
    """The same articles as archive documents in JSON text, one document per row."""
    rows = articles(spark, folder)

    def tag(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    tags = F.array(
        tag("organizations", F.col("section_name")),
        tag("subject", F.lit("prose")),
        tag("organizations", F.col("news_desk")),
    )
    doc = F.struct(
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.when(F.col("doc_id") % 2 == 0, F.lit("T05:00:00+0000"))
                 .otherwise(F.lit("T05:00:00.000Z"))).alias("pub_date"),
        F.col("section_name"),
        F.when(F.col("doc_id") % 7 != 0, F.col("news_desk")).alias("news_desk"),
        F.struct(F.col("headline").alias("main")).alias("headline"),
        F.col("abstract"),
        F.when(F.col("doc_id") % 5 != 0, tags).alias("keywords"),
    )
    return rows.select(F.to_json(F.struct(F.struct(F.array(doc).alias("docs")).alias("response"))).alias("json"))


def labelled_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Human labels as a stand-in for scored sentiment: quality minus toxicity."""
    return table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("sentiment")
    )


def option_chain(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    spot = parts.groupBy(F.col("p_brand").alias("symbol")).agg(F.avg("p_retailprice").alias("spot"))
    quotes = parts.select(
        F.col("p_brand").alias("symbol"),
        "p_partkey",
        F.date_add(F.lit(dt.date(2002, 1, 1)), (F.col("p_partkey") % 4 * 30).cast("int")).alias("expiration"),
        F.when(F.floor(F.col("p_partkey") / 4) % 2 == 0, F.lit("call")).otherwise(F.lit("put")).alias("side"),
        F.col("p_retailprice").alias("strike"),
        ((F.col("p_size") - 1) / 8.0).alias("iv"),
    )
    return quotes.join(spot, "symbol")


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as headlines: one row per item; every conversation is the feed of its own symbol."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("symbol"),
        (F.col("conv_id") % 7 != 0).alias("fetch_ok"),
        F.struct("conv_id", "turn").alias("position"),
        F.when(F.col("turn") % 3 != 0, F.col("role")).alias("title"),
        F.col("text").alias("summary"),
    )


def fundamentals_info(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as sparse key-value snapshots; every fifth one is an index."""
    suppliers = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    balance = F.col("s_acctbal")

    def entry(name: str, value, present=None):
        value = value.cast("string") if present is None else F.when(present, value.cast("string"))
        return F.lit(name), value

    company = key % 5 != 0
    parts = [
        entry("trailingPE", balance / 100, company),
        entry("forwardPE", balance / 125, company & (key % 3 != 0)),
        entry("marketCap", balance * 1e7, key % 4 != 0),
        entry("dividendYield", key % 3 * 0.5),
        entry("profitMargins", balance / 20000, company),
        entry("revenueGrowth", (key % 11 - 5) / 50, company),
        entry("sector", F.concat(F.lit("sector "), F.col("s_nationkey")), company),
        entry("fiftyTwoWeekLow", balance * 0.8),
        entry("fiftyTwoWeekHigh", balance * 1.2),
    ]
    symbol = F.when(key % 5 == 0, F.concat(F.lit("^"), F.col("s_name"))).otherwise(F.col("s_name"))
    return suppliers.select(
        symbol.alias("symbol"), F.create_map(*[item for pair in parts for item in pair]).alias("info")
    )
