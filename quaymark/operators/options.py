"""At-the-money implied volatility and skew of each symbol's chain."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import config


def implied_vol(chain: DataFrame, today: dt.date, target_days: int = config.OPTION_TARGET_DAYS) -> DataFrame:
    """(symbol, status, expiration, atm_iv, iv_skew) at the expiration nearest to ``target_days`` out.

    Every expiration is reduced first, then the nearest one is picked: two aggregations that
    combine before their shuffles, and no join back to the quotes.
    """
    valid = (F.col("iv") > config.IV_MIN) & (F.col("iv") < config.IV_MAX)

    def nearest(side: str, moneyness: float) -> Column:
        distance = F.abs(F.col("strike") - F.col("spot") * moneyness)
        usable = valid & (F.col("side") == side)
        return F.min_by("iv", F.when(usable, F.struct(distance, F.col("strike"), F.col("iv"))))

    per_expiration = chain.groupBy("symbol", "expiration").agg(
        nearest("call", 1.0).alias("atm_call"),
        nearest("put", 1.0).alias("atm_put"),
        nearest("put", 0.9).alias("otm_put"),
        nearest("call", 1.1).alias("otm_call"),
    )
    distance = F.abs(F.datediff("expiration", F.lit(today)) - target_days)
    row = F.struct("expiration", "atm_call", "atm_put", "otm_put", "otm_call")
    chosen = (
        per_expiration.groupBy("symbol")
        .agg(F.min_by(row, F.struct(distance, F.col("expiration"))).alias("_e"))
        .select("symbol", "_e.*")
    )
    quoted = F.col("atm_call").isNotNull() & F.col("atm_put").isNotNull()
    return chosen.select(
        "symbol",
        F.when(quoted, F.lit("ok")).otherwise(F.lit("no valid quotes")).alias("status"),
        "expiration",
        F.when(quoted, (F.col("atm_call") + F.col("atm_put")) / 2).alias("atm_iv"),
        F.when(quoted, F.col("otm_put") - F.col("otm_call")).alias("iv_skew"),
    )


def with_unlisted(snapshots: DataFrame, symbols: list[str]) -> DataFrame:
    """Add a row for asked symbols without any chain."""
    asked = snapshots.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    joined = asked.join(snapshots, "symbol", "full")
    return joined.withColumn("status", F.coalesce("status", F.lit("unavailable")))
