"""The computed columns of an order, as Column -> Column functions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
MS_PER_DAY = 86_400_000

# Fixed values.
PEAK_HOURS = ((12, 14), (19, 22))  # both ends included
PRICE_TIERS = (("Budget", 200), ("Mid-Range", 600))  # name, exclusive upper bound
TOP_PRICE_TIER = "Premium"
HIGH_VALUE_FROM = 1000
STATUS_LABELS = {
    "placed": "📥",
    "preparing": "👨‍🍳",
    "out_for_delivery": "🛵",
    "delivered": "✅",
    "cancelled": "❌",
}
UNKNOWN_STATUS_LABEL = "❓"

# What a Spark timestamp (64-bit microseconds) can hold, in seconds, and the
# days of the years 1 to 9999. A message may carry any 64-bit number as its
# time, and none of them may fail a job.
SECONDS_RANGE = (-9_223_372_036_854, 9_223_372_036_854)
DAYS_RANGE = (-719_162, 2_932_896)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; unknown counts as 0."""
    return F.when(condition, 1).otherwise(0)


def div64(value: Column, divisor: int) -> Column:
    """64-bit quotient, cut off toward zero."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def mod64(value: Column, divisor: int) -> Column:
    """64-bit remainder, never negative."""
    return F.pmod(value, F.lit(divisor).cast("bigint"))


def hour_of_day(epoch_ms: Column, tz: str = "UTC") -> Column:
    """Hour 0-23 in `tz`, whatever the session time zone is.

    Milliseconds are cut off toward zero, so that -1 ms is hour 0. In UTC the
    hour is plain integer arithmetic; another zone takes the way over a local
    timestamp. Beyond the timestamp range the hour is null in any zone.
    """
    seconds = div64(epoch_ms, 1000)
    second_of_day = mod64(seconds, SECONDS_PER_DAY)
    known = seconds.between(*SECONDS_RANGE)
    if tz == "UTC":
        return F.when(known, div64(second_of_day, 3600).cast("int"))
    day = div64(seconds - second_of_day, SECONDS_PER_DAY)
    utc = F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(
        secs=second_of_day
    )
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return F.when(known, F.hour(local))


def order_date(epoch_ms: Column) -> Column:
    """UTC date of an instant; null outside the years 1 to 9999."""
    day = div64(epoch_ms, MS_PER_DAY) - flag(epoch_ms % MS_PER_DAY < 0)
    return F.when(day.between(*DAYS_RANGE), F.date_from_unix_date(day.cast("int")))


def is_peak_hour(hour: Column) -> Column:
    """1 in the lunch and dinner hours."""
    return flag(functools.reduce(operator.or_, (hour.between(*window) for window in PEAK_HOURS)))


def order_value_category(price: Column) -> Column:
    """Price tier; a price that is unknown or not a number is in the top one."""
    tiers = functools.reduce(
        lambda case, tier: case.when(price < tier[1], tier[0]), PRICE_TIERS, F
    )
    return tiers.otherwise(TOP_PRICE_TIER)


def price_per_item(price: Column, quantity: Column) -> Column:
    """Price over quantity; null for quantity 0, also in ANSI mode."""
    return F.try_divide(price, quantity).cast("float")


def is_high_value(price: Column) -> Column:
    return flag(price >= HIGH_VALUE_FROM)


def joined_words(text: Column) -> Column:
    """The words of a text as a list in one string, as the dishes of an order are given."""
    return F.concat_ws(", ", F.split(text, " "))


def status_label(status: Column) -> Column:
    """The sign a status is shown with."""
    signs = F.create_map(*(F.lit(part) for pair in STATUS_LABELS.items() for part in pair))
    return F.coalesce(F.try_element_at(signs, status), F.lit(UNKNOWN_STATUS_LABEL))
