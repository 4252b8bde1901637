"""Article flags, gated sentiment scoring and daily news aggregates."""

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import config

BLANKS = " \t\n\r\x0b\x0c"


def is_business(
    section: Column,
    desk: Column,
    sections: list[str] = config.BUSINESS_SECTIONS,
    desks: list[str] = config.BUSINESS_DESKS,
) -> Column:
    return section.isin(sections) | desk.isin(desks)


def mentioned(keywords: dict[str, list[str]], business: Column, orgs: Column, text: Column) -> Column:
    """Tickers an article names: by organization tag, or by text inside business news. ``orgs`` and ``text`` are in lower case."""

    def any_of(where: Column, words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(where, F.lit(word)) for word in words])

    hits = [
        F.when(any_of(orgs, words) | (business & any_of(text, words)), F.lit(ticker))
        for ticker, words in keywords.items()
    ]
    return F.array_compact(F.array(*hits))


def flag_articles(
    articles: DataFrame,
    keywords: dict[str, list[str]] = config.COMPANY_KEYWORDS,
    sections: list[str] = config.BUSINESS_SECTIONS,
    desks: list[str] = config.BUSINESS_DESKS,
) -> DataFrame:
    """Add ``business_ctx`` and ``tickers``; row-local, so no shuffle.

    Texts are put together and lowered once, in a projection of their own, and only those of business news.
    """
    business = F.col("business_ctx")
    text = F.lower(F.concat(F.col("headline"), F.lit(" "), F.col("abstract")))
    flagged = articles.withColumn(
        "business_ctx", is_business(F.col("section_name"), F.col("news_desk"), sections, desks)
    ).withColumns({"_orgs": F.lower("organizations"), "_text": F.when(business, text)})
    return flagged.withColumn("tickers", mentioned(keywords, business, F.col("_orgs"), F.col("_text"))).drop("_orgs", "_text")


def relevant_text(flagged: DataFrame) -> Column:
    """Text to score, NULL for articles nobody aggregates or without any text."""
    text = F.btrim(F.concat(F.col("headline"), F.lit(". "), F.col("abstract")), F.lit(BLANKS))
    relevant = F.col("business_ctx") | (F.size("tickers") > 0)
    return F.when(relevant & (text != "") & (text != "."), text)


def text_scorer(load: Callable[[], Callable[[list[str]], list[float]]], batch: int = config.SCORER_BATCH):
    """A column function around any batch scorer; ``load`` runs once per task, NULL texts never reach it."""

    @F.pandas_udf("double")
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for chunk in chunks:
            texts = chunk.dropna()
            scores: list[float] = []
            for start in range(0, len(texts), batch):
                scores.extend(model(texts.iloc[start : start + batch].tolist()))
            yield pd.Series(scores, index=texts.index, dtype="float64").reindex(chunk.index)

    return score


def score_articles(flagged: DataFrame, scorer) -> DataFrame:
    """Add ``sentiment``. Only gated texts cross into Python; no join back is needed."""
    return flagged.withColumn("sentiment", scorer(relevant_text(flagged)))


def daily_news(scored: DataFrame, *by: str) -> DataFrame:
    """(by, scope, date, sentiment_mean, n): one scope for the market and one per mentioned ticker.

    Partial aggregation before the shuffle keeps a scope with most of the articles cheap.
    """
    market = F.when(F.col("business_ctx"), F.lit(config.MARKET_SCOPE))
    scopes = F.array_compact(F.concat(F.array(market), F.col("tickers")))
    rows = scored.select(*by, "date", "sentiment", F.explode(scopes).alias("scope"))
    return rows.groupBy(*by, "scope", "date").agg(
        F.avg("sentiment").alias("sentiment_mean"), F.count("sentiment").alias("n")
    )


def daily_news_wide(daily: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per day: market and company means and counts as columns."""

    def measures(scope: str) -> list[Column]:
        here = F.col("scope") == scope
        return [
            F.max(F.when(here, F.col("sentiment_mean"))).alias(f"news_{scope}_sentiment_mean"),
            F.max(F.when(here, F.col("n"))).alias(f"news_{scope}_count"),
        ]

    columns = [column for scope in [config.MARKET_SCOPE, *tickers] for column in measures(scope)]
    return daily.groupBy("date").agg(*columns)


def ticker_news(
    daily: DataFrame, tickers: list[str], covered: list[str] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """(ticker, date, 5 news features) for every day with any news.

    ``tickers`` without company coverage of their own read the market signal instead.
    """
    covered = list(config.COMPANY_KEYWORDS) if covered is None else covered
    # One entry per scope of a day: the market and the covered tickers.
    entry = F.struct("scope", F.struct("sentiment_mean", "n").alias("v"))
    days = daily.groupBy(*by, "date").agg(F.map_from_entries(F.collect_list(entry)).alias("_scopes"))
    readers = F.array(
        *[
            F.struct(F.lit(t).alias("ticker"), F.lit(t if t in covered else config.MARKET_SCOPE).alias("scope"))
            for t in tickers
        ]
    )
    grid = days.withColumn("_r", F.explode(readers))
    own, market = F.col("_scopes")[F.col("_r.scope")], F.col("_scopes")[F.lit(config.MARKET_SCOPE)]
    count = F.coalesce(own["n"], F.lit(0))
    return grid.select(
        *by,
        F.col("_r.ticker").alias("ticker"),
        "date",
        own["sentiment_mean"].alias("news_company_sentiment_mean"),
        count.alias("news_company_count"),
        (count > 0).cast("int").alias("news_company_had_news"),
        market["sentiment_mean"].alias("news_market_sentiment_mean"),
        F.coalesce(market["n"], F.lit(0)).alias("news_market_count"),
    )
