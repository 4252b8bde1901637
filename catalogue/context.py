"""Options, headline pulse, fundamentals and the leakage audit."""

from pyspark.sql import functions as F

from catalogue.common import BARS, emit, names, portable, query
from catalogue.news import COVERED, LEXICON, LEXICON_SQL, TICKERS, scored
from quaymark import config, schemas
from quaymark.operators import audit, options, pulse, sentiment
from quaymark.session import settle
from quaymark.sources import derived, fundamentals


def atm_iv_skew(spark, folder):
    return portable(options.implied_vol(derived.option_chain(spark, folder), derived.OPTIONS_TODAY))


def atm_iv_skew_with_unlisted(spark, folder):
    """Asked for every brand and two symbols nobody lists."""
    chain = derived.option_chain(spark, folder)
    snaps = options.implied_vol(chain.drop("p_partkey"), derived.OPTIONS_TODAY)
    asked = pulse.ordered_symbols([f"Brand#{k}" for k in range(1, 26)], ["NONE#1", "NONE#2"])
    return portable(options.with_unlisted(snaps, asked).select("symbol", "status", "atm_iv"))


def feeds(spark, folder):
    """Feeds per symbol plus one reachable symbol without any headline."""
    items = derived.headlines(spark, folder)
    nested = pulse.feeds_from_items(items).withColumn("fetch_ok", F.col("symbol").cast("long") % 7 != 0)
    quiet = spark.createDataFrame(
        [("^VIX", True, [])], "symbol string, fetch_ok boolean, items array<struct<title:string,summary:string>>"
    )
    return nested.unionByName(quiet)


def headline_texts(spark, folder):
    rows = feeds(spark, folder).select("symbol", F.posexplode(pulse.headline_texts(F.col("items"))).alias("pos", "text"))
    return portable(rows.select("symbol", "pos", F.md5(F.col("text").cast("binary")).alias("md5")))


def headline_pulse(spark, folder):
    return portable(pulse.market_pulse(feeds(spark, folder), sentiment.lexicon_table(spark, LEXICON)))


def fundamentals_flat(spark, folder):
    return portable(fundamentals.flatten_fundamentals(derived.fundamentals_info(spark, folder)))


def leakage_audit_own(spark, folder):
    return portable(audit.audit_own(settle(derived.daily_bars(spark, folder))))


def leakage_audit_macro(spark, folder):
    return portable(audit.audit_macro(derived.daily_bars(spark, folder), settle(derived.macro_bars(spark, folder))))


def leakage_audit_news(spark, folder):
    return portable(audit.audit_news(derived.daily_bars(spark, folder), settle(scored(spark, folder)), TICKERS, COVERED))


CHAIN = (
    "chain AS (SELECT p_brand AS symbol, p_partkey, DATE '2002-01-01' + CAST(30 * (p_partkey % 4) AS INTEGER) AS expiration, "
    "CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'call' ELSE 'put' END AS side, p_retailprice AS strike, (p_size - 1) / CAST(8 AS DOUBLE) AS iv, "
    "avg(p_retailprice) OVER (PARTITION BY p_brand) AS spot FROM part)"
)


def _iv(where: str = "TRUE") -> str:
    def nearest(side: str, m: str) -> str:
        return (
            f"(SELECT arg_min(iv, (abs(strike - spot * CAST({m} AS DOUBLE)), strike, iv)) FROM quotes q "
            f"WHERE q.symbol = x.symbol AND q.expiration = x.expiration AND side = '{side}' AND iv > 0.01 AND iv < 5)"
        )

    return (
        f"quotes AS (SELECT * FROM chain WHERE {where}), "
        "x AS (SELECT symbol, arg_min(expiration, (abs(date_diff('day', DATE '2001-12-20', expiration) - 30), expiration)) AS expiration FROM quotes GROUP BY 1), "
        f"iv0 AS (SELECT symbol, expiration, {nearest('call', '1')} AS ac, {nearest('put', '1')} AS ap, {nearest('put', '0.9')} AS op, {nearest('call', '1.1')} AS oc FROM x), "
        "ivs AS (SELECT symbol, CASE WHEN ac IS NOT NULL AND ap IS NOT NULL THEN 'ok' ELSE 'no valid quotes' END AS status, expiration, "
        "(ac + ap) / 2 AS atm_iv, CASE WHEN ac IS NOT NULL AND ap IS NOT NULL THEN op - oc END AS iv_skew FROM iv0)"
    )


ASKED = [f"Brand#{k}" for k in range(1, 26)] + ["NONE#1", "NONE#2"]
FEED = (
    "hl AS (SELECT CAST(conv_id AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, "
    "trim((CASE WHEN turn % 3 <> 0 THEN role ELSE '' END) || '. ' || coalesce(text, ''), ' \t\n\r\x0b\x0c') AS text FROM conversations), "
    "top AS (SELECT * FROM hl)"
)
PULSE = (
    "pw AS (SELECT symbol, pos, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM top WHERE CAST(symbol AS BIGINT) % 7 <> 0), "
    "ps AS (SELECT symbol, pos, coalesce(sum(valence), 0) AS s FROM pw LEFT JOIN lex USING (word) GROUP BY ALL), "
    "pm AS (SELECT symbol, count(*) AS n, avg(s / sqrt(s * s + 15)) AS m FROM ps GROUP BY 1), "
    "pulse AS (SELECT symbol, n AS n_headlines, m AS avg_compound, TRUE AS had_news, CASE WHEN m > 0.15 THEN 'positive' WHEN m < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM pm "
    "UNION ALL SELECT DISTINCT symbol, 0, NULL, NULL, 'unavailable (fetch failed)' FROM top WHERE CAST(symbol AS BIGINT) % 7 = 0 "
    "UNION ALL SELECT '^VIX', 0, NULL, FALSE, 'no recent news')"
)
FUND = (
    "fu AS (SELECT CASE WHEN k % 5 = 0 THEN '^' ELSE '' END || s_name AS symbol, CASE WHEN k % 5 <> 0 THEN b / 100 END AS trailing_pe, "
    "CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN b / 125 END AS forward_pe, CASE WHEN k % 4 <> 0 THEN nullif(b * 1e7, 0) / 1e9 END AS market_cap_billions, "
    "CAST(NULL AS DOUBLE) AS price_to_book, nullif(k % 3 * CAST(0.5 AS DOUBLE), 0) AS dividend_yield_pct, CAST(NULL AS DOUBLE) AS beta, "
    "CASE WHEN k % 5 <> 0 THEN b / 20000 * 100 END AS profit_margin_pct, CASE WHEN k % 5 <> 0 THEN (k % 11 - 5) / CAST(50 AS DOUBLE) * 100 END AS revenue_growth_pct, "
    "CASE WHEN k % 5 <> 0 THEN 'sector ' || s_nationkey ELSE 'Index, not a company' END AS sector, b * CAST(0.8 AS DOUBLE) AS \"52w_low\", b * CAST(1.2 AS DOUBLE) AS \"52w_high\" "
    "FROM (SELECT *, s_suppkey AS k, s_acctbal AS b FROM supplier))"
)


def _audit(n_columns: int) -> str:
    """Every cut of at least 60 rows was checked and nothing leaked."""
    shares = ", ".join(f"CAST({s} AS DOUBLE)" for s in config.LEAK_CUTOFFS)
    return query(
        BARS,
        "n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY 1)",
        f"c AS (SELECT DISTINCT ticker, CAST(floor(n * unnest([{shares}])) AS BIGINT) AS cut FROM n)",
        f"a AS (SELECT ticker, count(*) AS n_cutoffs, count(*) * {n_columns} AS n_checked, 0 AS n_leaks, '' AS leaking FROM c WHERE cut >= 60 GROUP BY 1)",
        emit("a", "ticker n_cutoffs:i n_checked:i n_leaks:i leaking"),
    )


QUERIES = {
    "atm_iv_skew": atm_iv_skew,
    "atm_iv_skew_with_unlisted": atm_iv_skew_with_unlisted,
    "headline_texts": headline_texts,
    "headline_pulse": headline_pulse,
    "fundamentals_flat": fundamentals_flat,
    "leakage_audit_own": leakage_audit_own,
    "leakage_audit_macro": leakage_audit_macro,
    "leakage_audit_news": leakage_audit_news,
}

ORACLES = {
    "atm_iv_skew": query(CHAIN, _iv(), emit("ivs", "symbol status expiration:d atm_iv:f iv_skew:f")),
    "atm_iv_skew_with_unlisted": query(
        CHAIN,
        _iv(),
        f"asked AS (SELECT unnest([{names(ASKED)}]) AS symbol)",
        "r AS (SELECT symbol, status, atm_iv FROM ivs UNION ALL SELECT symbol, 'unavailable', NULL FROM asked WHERE symbol NOT IN (SELECT symbol FROM ivs))",
        emit("r", "symbol status atm_iv:f"),
    ),
    "headline_texts": query(
        FEED, "h AS (SELECT symbol, pos, md5(text) AS md5 FROM top WHERE text <> '')", emit("h", "symbol pos:i md5")
    ),
    "headline_pulse": query(
        FEED, LEXICON_SQL, PULSE, emit("pulse", "symbol n_headlines:i avg_compound:f had_news:b label")
    ),
    "fundamentals_flat": query(
        FUND,
        emit(
            "fu",
            "symbol trailing_pe:f forward_pe:f market_cap_billions:f price_to_book:f dividend_yield_pct:f beta:f profit_margin_pct:f "
            "revenue_growth_pct:f sector 52w_low:f 52w_high:f",
        ),
    ),
    "leakage_audit_own": _audit(len(schemas.OWN_FEATURES)),
    "leakage_audit_macro": _audit(len(schemas.MACRO_FEATURES)),
    "leakage_audit_news": _audit(len(schemas.NEWS_FEATURES)),
}
