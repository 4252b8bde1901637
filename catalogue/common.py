"""Helpers shared by the query families: portable output types and SQL building blocks."""

from pyspark.sql import DataFrame

from quaymark.sources import derived


# Both engines cut doubles to six digits with this shift. Sums of the same numbers in another order
# differ in the last bit, and many prices are exact decimal ties, so the cut must not lie on ties.
SHIFT = 0.5123


def portable(df: DataFrame) -> DataFrame:
    """Types two engines agree on: cut doubles, long integers, text for days, times and flags."""
    forms = {
        "double": f"floor(`{{0}}` * 1e6D + {SHIFT}D) / 1e6D",
        "float": f"floor(cast(`{{0}}` as double) * 1e6D + {SHIFT}D) / 1e6D",
        "int": "cast(`{0}` as bigint)",
        "date": "cast(`{0}` as string)",
        "boolean": "cast(`{0}` as string)",
        "timestamp": "date_format(`{0}`, 'yyyy-MM-dd HH:mm:ss')",
        "timestamp_ntz": "date_format(`{0}`, 'yyyy-MM-dd HH:mm:ss')",
    }
    return df.selectExpr(*[forms.get(kind, "`{0}`").format(name) + f" AS `{name}`" for name, kind in df.dtypes])


def emit(source: str, spec: str) -> str:
    """SELECT list out of ``name:kind`` words; kinds: f double, i integer, d day, b flag, t time."""
    forms = {
        "f": f'floor(CAST("{{0}}" AS DOUBLE) * 1e6 + CAST({SHIFT} AS DOUBLE)) / 1e6',
        "i": 'CAST("{0}" AS BIGINT)',
        "d": 'CAST(CAST("{0}" AS DATE) AS VARCHAR)',
        "b": 'CAST("{0}" AS VARCHAR)',
        "t": "strftime(\"{0}\", '%Y-%m-%d %H:%M:%S')",
        "s": '"{0}"',
    }
    columns = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        name = name.replace("~", " ")
        columns.append(forms[kind or "s"].format(name) + f' AS "{name}"')
    return f"SELECT {', '.join(columns)} FROM {source}"


def query(*parts: str) -> str:
    """WITH all parts but the last, then the last."""
    *ctes, last = parts
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + last


def over(n: int, keys: str = "ticker", order: str = "date") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(fn: str, x: str, n: int, keys: str = "ticker") -> str:
    w = over(n, keys)
    return f"CASE WHEN count({x}) {w} >= {n} THEN {fn}({x}) {w} END"


def change(x: str, k: int, keys: str = "ticker") -> str:
    return f"({x} / nullif(lag({x}, {k}) OVER (PARTITION BY {keys} ORDER BY date), 0) - 1)"


def names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def bars_from(source: str) -> str:
    return (
        "arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, "
        f"arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {source} GROUP BY ALL"
    )


BARS = (
    "bars AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, "
    + bars_from("orders JOIN customer ON o_custkey = c_custkey")
    + ")"
)
MARKET = "market AS (SELECT 'MARKET' AS ticker, CAST(o_orderdate AS DATE) AS date, " + bars_from("orders") + ")"
ALL_BARS = "allbars AS (SELECT * FROM bars UNION ALL SELECT * FROM market)"
BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)"
MACRO = (
    f"macro AS (SELECT coalesce(list_extract([{names(derived.SERIES_NAMES)}], {BRAND}), p_brand) AS series, "
    "CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
)
EVENT_DAYS = (
    "edays AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, "
    "max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, "
    "CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)"
)
INTRADAY = (
    "ibars AS (SELECT event_type AS ticker, "
    "time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2024-01-01 00:30:00') AS ts, "
    "arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, "
    "arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events "
    "WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960 GROUP BY ALL)"
)
ARTICLES = (
    "articles AS (SELECT doc_id, DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INTEGER) AS date, "
    "source AS section_name, lang AS news_desk, substring(text, 1, 80) AS headline, "
    "substring(text, 81) AS abstract, "
    "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || '; ' || lang END AS organizations FROM documents)"
)


def _mention(ticker: str, words: list[str]) -> str:
    org = " OR ".join(f"contains(lower(organizations), '{w}')" for w in words)
    text = " OR ".join(f"contains(lower(headline || ' ' || abstract), '{w}')" for w in words)
    return f"CASE WHEN {org} OR (business_ctx AND ({text})) THEN '{ticker}' END"


FLAGGED = (
    "ctx AS (SELECT *, section_name IN ("
    + names(derived.BUSINESS_SECTIONS)
    + ") OR news_desk IN ("
    + names(derived.BUSINESS_DESKS)
    + ") AS business_ctx FROM articles), flagged AS (SELECT *, [x FOR x IN ["
    + ", ".join(_mention(t, w) for t, w in derived.SEGMENT_KEYWORDS.items())
    + "] IF x IS NOT NULL] AS tickers FROM ctx)"
)
SCORED = (
    "scored AS (SELECT f.*, CASE WHEN business_ctx OR len(tickers) > 0 "
    "THEN CAST(quality - toxic AS DOUBLE) END AS sentiment "
    "FROM flagged f LEFT JOIN labels l ON f.doc_id = l.doc_id)"
)
NEWS_DAILY = (
    "scopes AS (SELECT date, sentiment, 'market' AS scope FROM scored WHERE business_ctx UNION ALL "
    "SELECT date, sentiment, unnest(tickers) AS scope FROM scored), "
    "ndaily AS (SELECT scope, date, avg(sentiment) AS sentiment_mean, count(sentiment) AS n FROM scopes GROUP BY ALL)"
)
