"""Small labelled outcomes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark import config


def direction(probability_up: Column, threshold: float = config.UP_THRESHOLD) -> Column:
    return F.when(probability_up > threshold, F.lit("UP")).otherwise(F.lit("DOWN"))


def direction_of_return(value: Column) -> Column:
    return F.when(value > 0, F.lit("UP")).otherwise(F.lit("DOWN"))


def predicted_price(last_close: Column, predicted_return: Column) -> Column:
    return last_close * (F.lit(1.0) + predicted_return)


def sentiment_label(mean: Column, cutoff: float = config.PULSE_LABEL_CUTOFF) -> Column:
    return (
        F.when(mean > cutoff, F.lit("positive"))
        .when(mean < -cutoff, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def hit_rate_cell(rate: Column, reliable: Column, independent_n: Column) -> Column:
    """Printable hit rate with its honest sample size."""
    warning = F.when(reliable, F.lit("")).otherwise(F.lit(" (unreliable, <20 windows)"))
    text = F.format_string("%.1f%%%s  [~%d indep.]", rate * 100, warning, independent_n)
    return F.when(rate.isNotNull(), text).otherwise(F.lit("n/a"))


def confidence_text(independent_n: Column) -> Column:
    thin = F.lit("LOW -- based on essentially one independent historical window; descriptive, not validated")
    some = F.format_string(
        "based on ~%d independent historical windows -- still thin by normal standards", independent_n
    )
    return F.when(independent_n <= 1, thin).otherwise(some)
