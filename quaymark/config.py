"""Settings shared by every job. Values below are fixed values of the domain."""

# Provider symbol -> instrument name.
TICKERS = {
    "^GSPC": "SP500",
    "AAPL": "AAPL",
    "PLTR": "PLTR",
    "MSFT": "MSFT",
    "GOOGL": "GOOGL",
    "AMZN": "AMZN",
    "NVDA": "NVDA",
    "META": "META",
}
MARKET_TICKER = "SP500"

# Provider symbol -> cross-market series name.
MACRO_SERIES = {
    "^VIX": "VIX",
    "^TNX": "TNX",
    "UUP": "DXY",
    "CL=F": "OIL",
    "GC=F": "GOLD",
    "^DJI": "DJI",
    "^IXIC": "IXIC",
    "^RUT": "RUT",
    "HYG": "HYG",
    "IEF": "IEF",
    "QQQ": "QQQ",
    "^IRX": "IRX",
    "^N225": "NIKKEI",
    "^FTSE": "FTSE",
    "^GDAXI": "DAX",
    "BTC-USD": "BTC",
    "^VXN": "VXN",
}

# Round-trip trading cost in basis points.
TRANSACTION_COST_BPS = {
    "SP500": 2,
    "AAPL": 3,
    "PLTR": 8,
    "MSFT": 2,
    "GOOGL": 3,
    "AMZN": 3,
    "NVDA": 3,
    "META": 3,
}
DEFAULT_COST_BPS = 5

# Decision, split and validation settings.
UP_THRESHOLD = 0.52
TEST_FRACTION = 0.15
MIN_TEST_ROWS = 30
MIN_TEST_DAYS = 10
TUNING_FOLDS = 3
STABILITY_FOLDS = 4
MIN_FOLD_ROWS = 10
SEARCH_DRAWS = 10
TOP_FEATURES = 20
RANDOM_SEED = 42
RECENCY_HALF_LIFE_ROWS = 504
RECENCY_HALF_LIFE_DAYS = RECENCY_HALF_LIFE_ROWS * 365.25 / 252
MAX_DRAWDOWN_STOP_PCT = 8.0
BACKTEST_DAYS = 30
LEAK_CUTOFFS = (0.3, 0.5, 0.7, 0.9, 0.99)
LEAK_MIN_ROWS = 60
LEAK_TOLERANCE = 1e-9

# Holding horizons in trading days.
HORIZONS = {
    "1 week": 5,
    "2 weeks": 10,
    "1 month": 21,
    "2 months": 42,
    "3 months": 63,
    "6 months": 126,
    "9 months": 189,
    "1 year": 252,
    "18 months": 378,
    "2 years": 504,
}
FORECAST_HORIZONS = {"3 months": 63, "6 months": 126, "9 months": 189, "12 months": 252}
FORECAST_TO_HIT_RATE_LABEL = {
    "3 months": "3 months",
    "6 months": "6 months",
    "9 months": "9 months",
    "12 months": "1 year",
}
VERIFY_HORIZONS = {"1 month": 21, "3 months": 63, "6 months": 126, "9 months": 189, "1 year": 252}
COMPARISON_HORIZONS = ["1 month", "3 months", "6 months", "1 year"]
ANCHOR_DAYS_AGO = 252
ANCHOR_MIN_HISTORY = 60
MIN_TEST_WINDOWS = 20
SHRINKAGE_STRENGTH = 20
RELIABLE_HIT_RATE = 0.80
LIVE_ESTIMATOR = "recency_weighted_median_shrunk"

# Which sections and desks count as business news.
BUSINESS_SECTIONS = ["Business Day", "Business", "Technology", "DealBook", "Your Money", "Media"]
BUSINESS_DESKS = ["Business", "Financial", "SundayBusiness", "Technology"]

# Lower-case keywords that name a company.
COMPANY_KEYWORDS = {
    "AAPL": ["apple inc", "apple"],
    "PLTR": ["palantir"],
    "MSFT": ["microsoft"],
    "GOOGL": ["google", "alphabet inc"],
    "AMZN": ["amazon.com", "amazon inc"],
    "NVDA": ["nvidia"],
    "META": ["facebook inc", "meta platforms"],
}
MARKET_SCOPE = "market"
SCORER_BATCH = 64

# Live headline readout.
PULSE_EXTRA_SYMBOLS = ["^GSPC", "^VIX"]
PULSE_MAX_ITEMS = 10
PULSE_LABEL_CUTOFF = 0.15

# Option chain readout.
OPTION_TARGET_DAYS = 30
IV_MIN, IV_MAX = 0.01, 5.0

# Trading session clock.
MARKET_TZ = "America/New_York"
SESSION_CLOSE_MINUTE = 16 * 60
SESSION_MINUTES = 390
MIN_SESSION_BARS = 3
MIN_INTRADAY_ROWS = 200
# Right-closed minutes-to-close buckets.
TIME_BUCKETS = [
    (0, 60, "<1h to close"),
    (60, 120, "1-2h"),
    (120, 180, "2-3h"),
    (180, 240, "3-4h"),
    (240, 300, "4-5h"),
    (300, 390, ">5h to close"),
]

# Outage guard of the bar store.
GUARD_MIN_ROWS = 20
GUARD_RATIO = 0.5

# Hyper-parameter grids of the tree candidates.
FOREST_GRID = {
    "numTrees": [150, 250, 350],
    "maxDepth": [3, 4, 5, 6, 8],
    "minInstancesPerNode": [3, 5, 10, 20],
    "featureSubsetStrategy": ["sqrt", "0.5", "0.8"],
}
BOOST_GRID = {
    "maxIter": [100, 200, 300],
    "maxDepth": [3, 4, 6, 8],
    "stepSize": [0.02, 0.05, 0.1],
}
