"""Articles, mentions, gated sentiment and daily news features."""

import datetime as dt

from pyspark.sql import functions as F

from catalogue.common import ARTICLES, BARS, FLAGGED, NEWS_DAILY, SCORED, emit, names, portable, query
from quaymark import schemas
from quaymark.operators import asof, news, sentiment
from quaymark.sources import articles as article_source
from quaymark.sources import derived

TICKERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
COVERED = list(derived.SEGMENT_KEYWORDS)
LEXICON = {
    "that": 0.9, "with": 0.4, "from": -0.7, "was": -1.3, "this": 0.6, "for": -0.2,
    "der": -0.8, "und": 0.7, "que": 0.3, "les": -0.4, "worthless": -1.9, "are": 1.1,
}


def flagged(spark, folder):
    return news.flag_articles(
        derived.articles(spark, folder),
        derived.SEGMENT_KEYWORDS,
        derived.BUSINESS_SECTIONS,
        derived.BUSINESS_DESKS,
    )


def scored(spark, folder):
    """Flagged articles with the label as their sentiment; texts stay behind in the scan."""
    marked = flagged(spark, folder).select("doc_id", "date", "business_ctx", "tickers")
    labelled = marked.join(derived.labelled_sentiment(spark, folder), "doc_id", "left")
    relevant = F.col("business_ctx") | (F.size("tickers") > 0)
    return labelled.withColumn("sentiment", F.when(relevant, F.col("sentiment")))


def articles_slim(spark, folder):
    slim = article_source.slim_articles(derived.archive_json(spark, folder))
    return portable(
        slim.select(
            article_source.published_on(F.col("pub_date")).alias("date"),
            "section_name",
            "news_desk",
            F.md5(F.col("headline").cast("binary")).alias("headline_md5"),
            F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"),
            "organizations",
        )
    )


def business_articles(spark, folder):
    marked = flagged(spark, folder).where("business_ctx")
    return portable(marked.groupBy("section_name", "news_desk").agg(F.count(F.lit(1)).alias("n")))


def entity_mentions(spark, folder):
    marked = flagged(spark, folder)
    return portable(marked.select("doc_id", F.explode("tickers").alias("ticker"), "business_ctx"))


def relevance_gate(spark, folder):
    marked = flagged(spark, folder)
    gated = marked.withColumn("text", news.relevant_text(marked)).where(F.col("text").isNotNull())
    return portable(gated.select("doc_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5")))


def scored_month_refresh(spark, folder):
    """Months of the first half were scored already; what is left plus the open month is scored."""
    rows = article_source.with_month(derived.articles(spark, folder))
    done = rows.where(F.col("date") <= dt.date(1998, 6, 15)).select("year", "month")
    todo = article_source.months_to_score(rows, done, dt.date(1998, 6, 15))
    return portable(todo.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")))


def month_range_scan(spark, folder):
    rows = article_source.with_month(derived.articles(spark, folder))
    picked = article_source.month_range(rows, "1996-11", "1997-02")
    return portable(picked.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")))


def recent_months_scan(spark, folder):
    rows = article_source.with_month(derived.articles(spark, folder))
    picked = article_source.recent_months(rows, dt.date(2000, 1, 20))
    return portable(picked.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")))


def news_daily(spark, folder):
    return portable(news.daily_news(scored(spark, folder)))


def news_daily_wide(spark, folder):
    return portable(news.daily_news_wide(news.daily_news(scored(spark, folder)), COVERED))


def news_features_ticker(spark, folder):
    return portable(news.ticker_news(news.daily_news(scored(spark, folder)), TICKERS, COVERED))


def asof_align_news(spark, folder):
    block = news.ticker_news(news.daily_news(scored(spark, folder)), TICKERS, COVERED)
    bars = derived.daily_bars(spark, folder).select("ticker", "date", "close")
    return portable(asof.align_per_entity(bars, block, schemas.NEWS_FEATURES))


def lexicon_sentiment(spark, folder):
    marked = flagged(spark, folder)
    texts = marked.select("doc_id", news.relevant_text(marked).alias("text")).where(F.col("text").isNotNull())
    return portable(sentiment.lexicon_sentiment(texts, sentiment.lexicon_table(spark, LEXICON), "doc_id"))


def lexicon_news_daily(spark, folder):
    """Gate, score with the lexicon, aggregate per scope and day."""
    marked = flagged(spark, folder)
    keys = ("doc_id", "date", "business_ctx", "tickers")
    texts = marked.select(*keys, news.relevant_text(marked).alias("text"))
    scores = sentiment.lexicon_sentiment(texts, sentiment.lexicon_table(spark, LEXICON), *keys)
    return portable(news.daily_news(scores.withColumnRenamed("compound", "sentiment")))


def _balance_model():
    """A stand-in batch model: share of upper-case over lower-case initials."""

    def score(texts: list[str]) -> list[float]:
        return [(t.count("T") - t.count("O")) / (1.0 + t.count("T") + t.count("O")) for t in texts]

    return score


def pluggable_scorer(spark, folder):
    marked = flagged(spark, folder)
    result = news.score_articles(marked, news.text_scorer(_balance_model))
    return portable(result.select("doc_id", "sentiment"))


LEXICON_SQL = (
    "lex AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in LEXICON.items())
    + ") t(word, valence))"
)
GATED = (
    "gated AS (SELECT doc_id, date, business_ctx, tickers, trim(headline || '. ' || abstract, ' \t\n\r\x0b\x0c') AS text "
    "FROM flagged WHERE business_ctx OR len(tickers) > 0), "
    "texts AS (SELECT * FROM gated WHERE text <> '' AND text <> '.')"
)
COMPOUND = (
    "words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM texts), "
    "sums AS (SELECT doc_id, coalesce(sum(valence), 0) AS s, count(valence) AS n_hits FROM words LEFT JOIN lex USING (word) GROUP BY 1), "
    "comp AS (SELECT doc_id, s / sqrt(s * s + 15) AS compound, n_hits FROM sums)"
)
TICKER_NEWS = (
    "ndays AS (SELECT date, max(CASE WHEN scope = 'market' THEN sentiment_mean END) AS news_market_sentiment_mean, "
    "coalesce(max(CASE WHEN scope = 'market' THEN n END), 0) AS news_market_count FROM ndaily GROUP BY 1), "
    f"grid AS (SELECT ndays.*, t.ticker, CASE WHEN t.ticker IN ({names(COVERED)}) THEN t.ticker ELSE 'market' END AS scope "
    f"FROM ndays, (SELECT unnest([{names(TICKERS)}]) AS ticker) t), "
    "tnews AS (SELECT grid.ticker, grid.date, c.sentiment_mean AS news_company_sentiment_mean, "
    "coalesce(c.n, 0) AS news_company_count, CASE WHEN coalesce(c.n, 0) > 0 THEN 1 ELSE 0 END AS news_company_had_news, "
    "news_market_sentiment_mean, news_market_count FROM grid LEFT JOIN ndaily c ON c.scope = grid.scope AND c.date = grid.date)"
)
NEWS_SPEC = (
    "news_company_sentiment_mean:f news_company_count:i news_company_had_news:i "
    "news_market_sentiment_mean:f news_market_count:i"
)
CARRIED = (
    "both_ AS (SELECT ticker, date, close, TRUE AS is_row, "
    + ", ".join(f"CAST(NULL AS {'DOUBLE' if 'mean' in c else 'BIGINT'}) AS {c}" for c in schemas.NEWS_FEATURES)
    + " FROM bars UNION ALL SELECT ticker, date, NULL, FALSE, "
    + ", ".join(schemas.NEWS_FEATURES)
    + " FROM tnews), ncarried AS (SELECT ticker, date, close, is_row, "
    + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date, is_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        for c in schemas.NEWS_FEATURES
    )
    + " FROM both_)"
)
NEWS_CTES = (ARTICLES, FLAGGED, SCORED, NEWS_DAILY)
MONTHS = "m AS (SELECT year(date) AS year, month(date) AS month, count(*) AS n FROM articles GROUP BY ALL)"
WIDE = ", ".join(
    f"max(CASE WHEN scope = '{s}' THEN sentiment_mean END) AS \"news_{s}_sentiment_mean\", "
    f"max(CASE WHEN scope = '{s}' THEN n END) AS \"news_{s}_count\""
    for s in ["market", *COVERED]
)

QUERIES = {
    "articles_slim": articles_slim,
    "business_articles": business_articles,
    "entity_mentions": entity_mentions,
    "relevance_gate": relevance_gate,
    "scored_month_refresh": scored_month_refresh,
    "month_range_scan": month_range_scan,
    "recent_months_scan": recent_months_scan,
    "news_daily": news_daily,
    "news_daily_wide": news_daily_wide,
    "news_features_ticker": news_features_ticker,
    "asof_align_news": asof_align_news,
    "lexicon_sentiment": lexicon_sentiment,
    "lexicon_news_daily": lexicon_news_daily,
    "pluggable_scorer": pluggable_scorer,
}

ORACLES = {
    "articles_slim": query(
        ARTICLES,
        "s AS (SELECT date, section_name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE news_desk END AS news_desk, "
        "md5(headline) AS headline_md5, md5(abstract) AS abstract_md5, organizations FROM articles)",
        emit("s", "date:d section_name news_desk headline_md5 abstract_md5 organizations"),
    ),
    "business_articles": query(
        ARTICLES,
        FLAGGED,
        "g AS (SELECT section_name, news_desk, count(*) AS n FROM ctx WHERE business_ctx GROUP BY ALL)",
        emit("g", "section_name news_desk n:i"),
    ),
    "entity_mentions": query(
        ARTICLES,
        FLAGGED,
        "u AS (SELECT doc_id, unnest(tickers) AS ticker, business_ctx FROM flagged)",
        emit("u", "doc_id:i ticker business_ctx:b"),
    ),
    "relevance_gate": query(
        ARTICLES,
        FLAGGED,
        GATED,
        "g AS (SELECT doc_id, length(text) AS n_chars, md5(text) AS md5 FROM texts)",
        emit("g", "doc_id:i n_chars:i md5"),
    ),
    "scored_month_refresh": query(ARTICLES, MONTHS, emit("m", "year:i month:i n:i") + " WHERE year * 12 + month >= 1998 * 12 + 6"),
    "month_range_scan": query(
        ARTICLES, MONTHS, emit("m", "year:i month:i n:i") + " WHERE year * 12 + month BETWEEN 1996 * 12 + 11 AND 1997 * 12 + 2"
    ),
    "recent_months_scan": query(
        ARTICLES, MONTHS, emit("m", "year:i month:i n:i") + " WHERE (year = 1999 AND month = 12) OR (year = 2000 AND month = 1)"
    ),
    "news_daily": query(*NEWS_CTES, emit("ndaily", "scope date:d sentiment_mean:f n:i")),
    "news_daily_wide": query(
        *NEWS_CTES,
        f"w AS (SELECT date, {WIDE} FROM ndaily GROUP BY 1)",
        emit("w", "date:d " + " ".join(f"news_{s}_sentiment_mean:f news_{s}_count:i" for s in ["market", *COVERED])),
    ),
    "news_features_ticker": query(*NEWS_CTES, TICKER_NEWS, emit("tnews", f"ticker date:d {NEWS_SPEC}")),
    "asof_align_news": query(
        BARS, *NEWS_CTES, TICKER_NEWS, CARRIED, emit("ncarried", f"ticker date:d close:f {NEWS_SPEC}") + " WHERE is_row"
    ),
    "lexicon_sentiment": query(
        ARTICLES, FLAGGED, GATED, LEXICON_SQL, COMPOUND, emit("comp", "doc_id:i compound:f n_hits:i")
    ),
    "lexicon_news_daily": query(
        ARTICLES,
        FLAGGED,
        GATED,
        LEXICON_SQL,
        COMPOUND,
        "scored AS (SELECT f.date, f.business_ctx, f.tickers, c.compound AS sentiment FROM flagged f LEFT JOIN comp c ON c.doc_id = f.doc_id)",
        NEWS_DAILY,
        emit("ndaily", "scope date:d sentiment_mean:f n:i"),
    ),
    "pluggable_scorer": query(
        ARTICLES,
        FLAGGED,
        GATED,
        "c AS (SELECT doc_id, len(text) - len(replace(text, 'T', '')) AS t, len(text) - len(replace(text, 'O', '')) AS o FROM texts)",
        "r AS (SELECT flagged.doc_id, (t - o) / (CAST(1 AS DOUBLE) + t + o) AS sentiment FROM flagged LEFT JOIN c ON c.doc_id = flagged.doc_id)",
        emit("r", "doc_id:i sentiment:f"),
    ),
}
