"""Table contracts: explicit reader schemas and feature column lists."""

from pyspark.sql import types as T

DAILY_BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

INTRADAY_BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

MACRO_BARS = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
    ]
)

ARCHIVE_MONTH = T.StructType(
    [
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField(
                        "docs",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("pub_date", T.StringType()),
                                    T.StructField("section_name", T.StringType()),
                                    T.StructField("news_desk", T.StringType()),
                                    T.StructField("headline", T.StructType([T.StructField("main", T.StringType())])),
                                    T.StructField("abstract", T.StringType()),
                                    T.StructField(
                                        "keywords",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("name", T.StringType()),
                                                    T.StructField("value", T.StringType()),
                                                ]
                                            )
                                        ),
                                    ),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

TICKS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
    ]
)

# The instrument's own technical features.
OWN_FEATURES = [
    "ret_1d", "ret_2d", "ret_3d", "ret_5d", "ret_10d",
    "sma_5_ratio", "sma_10_ratio", "sma_20_ratio", "sma_50_ratio",
    "vol_5d", "vol_10d", "vol_20d",
    "rsi_14",
    "macd", "macd_signal", "macd_hist",
    "bb_position", "bb_width",
    "vol_change", "vol_ratio_20d",
    "hl_range",
    "dow_sin", "dow_cos",
]

# Cross-market features.
MACRO_FEATURES = [
    "vix_level", "vix_zscore", "vix_ret_1d",
    "tnx_level", "tnx_chg_1d_bp",
    "yield_curve_slope", "yield_curve_chg_1d_bp",
    "dxy_ret_1d",
    "oil_ret_1d", "oil_vol_10d",
    "gold_ret_1d",
    "dji_ret_1d", "ixic_ret_1d", "rut_ret_1d",
    "credit_stress", "credit_stress_chg_1d",
    "qqq_ret_1d",
    "nikkei_ret_1d", "ftse_ret_1d", "dax_ret_1d",
    "btc_ret_1d", "btc_vol_10d",
    "vxn_level", "vxn_zscore", "vxn_ret_1d",
]

# News features.
NEWS_FEATURES = [
    "news_company_sentiment_mean", "news_company_count", "news_company_had_news",
    "news_market_sentiment_mean", "news_market_count",
]

# Intraday snapshot features.
SNAPSHOT_FEATURES = [
    "minutes_until_close", "frac_of_day_elapsed", "ret_since_open", "ret_last_bar",
    "pos_in_range", "range_so_far_pct", "gap_from_prev_close", "prev_day_return",
    "vol_ratio_vs_typical", "dow_sin", "dow_cos",
]

FEATURE_SETS = {
    "baseline": OWN_FEATURES,
    "with_macro": OWN_FEATURES + MACRO_FEATURES,
    "with_macro_and_news": OWN_FEATURES + MACRO_FEATURES + NEWS_FEATURES,
}
