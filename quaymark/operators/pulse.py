"""Live headline readout: tri-state news presence and the mean sentiment of the first headlines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import labels
from quaymark.operators.news import BLANKS
from quaymark.operators.sentiment import lexicon_sentiment


def headline_texts(items: Column, limit: int | None = None) -> Column:
    """``title. summary`` of all items (or the first ``limit``), trimmed, empty ones dropped."""
    empty = F.lit("")
    texts = F.transform(
        items if limit is None else F.slice(items, 1, limit),
        lambda it: F.btrim(
            F.concat(F.coalesce(it["title"], empty), F.lit(". "), F.coalesce(it["summary"], empty)), F.lit(BLANKS)
        ),
    )
    return F.filter(texts, lambda t: t != "")


def ordered_symbols(*lists: list[str]) -> list[str]:
    """Symbols in first-seen order without repeats."""
    return list(dict.fromkeys(symbol for symbols in lists for symbol in symbols))


def feeds_from_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """(symbol, items array) from one row per headline; with ``limit`` only the first are shown.

    The rank filter of a limit (a live readout shows ``config.PULSE_MAX_ITEMS``) is applied before the
    shuffle, so a symbol with most of the headlines then ships at most ``limit`` rows per task.
    """
    ranked = items.withColumnRenamed("position", "_rank")
    if limit is not None:
        first = Window.partitionBy("symbol").orderBy("position")
        ranked = items.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit)
    nested = F.sort_array(F.collect_list(F.struct("_rank", "title", "summary")))
    return ranked.groupBy("symbol").agg(
        F.transform(nested, lambda it: F.struct(it["title"].alias("title"), it["summary"].alias("summary"))).alias(
            "items"
        )
    )


def market_pulse(feeds: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(symbol, n_headlines, avg_compound, had_news, label) of (symbol, fetch_ok, items)."""
    shown = F.when(F.col("fetch_ok"), headline_texts(F.col("items")))
    texts = feeds.select("symbol", "fetch_ok", F.posexplode_outer(shown).alias("pos", "text"))
    scored = lexicon_sentiment(texts, lexicon, "symbol", "fetch_ok", "pos")
    n = F.count("compound")
    means = scored.groupBy("symbol", "fetch_ok").agg(
        n.alias("n_headlines"), F.avg("compound").alias("avg_compound")
    )
    label = (
        F.when(~F.col("fetch_ok"), F.lit("unavailable (fetch failed)"))
        .when(F.col("n_headlines") == 0, F.lit("no recent news"))
        .otherwise(labels.sentiment_label(F.col("avg_compound")))
    )
    return means.select(
        "symbol",
        "n_headlines",
        "avg_compound",
        F.when(F.col("fetch_ok"), F.col("n_headlines") > 0).alias("had_news"),
        label.alias("label"),
    )
