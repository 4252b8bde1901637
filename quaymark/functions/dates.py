"""Calendar expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark import config


def weekday_sin(date: Column) -> Column:
    return F.sin(F.weekday(date) * F.lit(2 * math.pi / 5))


def weekday_cos(date: Column) -> Column:
    return F.cos(F.weekday(date) * F.lit(2 * math.pi / 5))


def add_business_days(date: Column, days: Column | int) -> Column:
    """``days`` weekdays after ``date``; a weekend start counts from the Friday before it."""
    days = F.lit(days) if isinstance(days, int) else days
    start = F.date_sub(date, F.greatest(F.weekday(date) - 4, F.lit(0)))
    weekends = F.floor((F.weekday(start) + days) / 5).cast("int")
    return F.date_add(start, (days + 2 * weekends).cast("int"))


def local_time(ts: Column, zone: str = config.MARKET_TZ) -> Column:
    """Wall-clock time in ``zone`` of an instant held in UTC."""
    return F.from_utc_timestamp(ts, zone)


def minutes_until_close(ts: Column) -> Column:
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.greatest(F.lit(config.SESSION_CLOSE_MINUTE) - seconds / 60.0, F.lit(0.0))


def event_order(ts: Column, event_id: Column) -> Column:
    """One number that sorts like (ts, event_id).

    A struct would do, but its buffer makes Spark sort all rows before the partial aggregation; a decimal fits
    the hash aggregation.
    """
    wide = "decimal(38,0)"
    room = F.lit("20000000000000000000").cast("decimal(20,0)")  # more than there are longs
    return F.unix_micros(ts).cast("decimal(18,0)") * room + (event_id.cast(wide) + F.lit(str(2**63)).cast(wide))
