"""Repeatable stand-ins for random draws, computed from an integer key.

The same key gives the same value on any machine, in any partitioning and on
a retried task, which random functions do not promise. All arithmetic stays
within 64 bits for any key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiffinlake.functions.order_columns import mod64

# What an order may hold.
PAYMENT_PERCENT = {
    "UPI": 40, "Credit Card": 20, "Debit Card": 15, "Cash on Delivery": 15, "Net Banking": 5, "Wallet": 5,
}
QUANTITY = (1, 6)
PRICE = (80.0, 1800.0)
DELIVERY_MINUTES = (15, 65)
RATING = (3.0, 5.0)
FIRST_ORDER_PERCENT = 10


def spread(key: Column, n: int, multiplier: int = 7919) -> Column:
    """`key * multiplier mod n` without leaving 64 bits."""
    rest, factor = mod64(key, n), multiplier % n
    return rest if factor == 1 else mod64(rest * F.lit(factor).cast("bigint"), n)


def weighted_pick(percentile: Column, percents: dict[str, int]) -> Column:
    """The label whose share of 0..99 holds `percentile`; the last one beyond."""
    *head, (last, _) = percents.items()
    case, bound = F, 0
    for label, percent in head:
        bound += percent
        case = case.when(percentile < bound, label)
    return case.otherwise(last)


def bounded_int(key: Column, low: int, high: int, multiplier: int = 1) -> Column:
    """An int from `low` to `high`, both included."""
    return (spread(key, high - low + 1, multiplier) + low).cast("int")


def bounded_real(key: Column, low: float, high: float, places: int, multiplier: int = 7919) -> Column:
    """A float from `low` to `high` with `places` decimals, exact in both engines."""
    unit = 10**places
    first, last = round(low * unit), round(high * unit)
    return ((spread(key, last - first + 1, multiplier) + first).cast("double") / unit).cast("float")


def one_in(key: Column, n: int) -> Column:
    """True for one key in `n`."""
    return mod64(key, n) == 0
