"""The computed columns of an order stream."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffinlake.functions import order_columns as oc
from tiffinlake.schema import RAW_COLUMNS

# Computed column -> the raw columns it needs.
NEEDS = {
    "hour_of_day": ("timestamp",),
    "is_peak_hour": ("timestamp",),
    "order_value_category": ("price",),
    "price_per_item": ("price", "quantity"),
    "is_high_value": ("price",),
}
FLAGS = ("discount_applied", "is_first_order")


def raw_columns(columns: Collection[str]) -> list[str]:
    """The raw columns that some columns of the table are made of."""
    needed = {need for name in columns for need in NEEDS.get(name, (name,))}
    return [name for name in RAW_COLUMNS if name in needed]


_COMPUTED: dict[str, Callable[[], Column]] = {
    "is_peak_hour": lambda: oc.is_peak_hour(F.col("hour_of_day")),
    "order_value_category": lambda: oc.order_value_category(F.col("price")),
    "price_per_item": lambda: oc.price_per_item(F.col("price"), F.col("quantity")),
    "is_high_value": lambda: oc.is_high_value(F.col("price")),
}


def enrich(orders: DataFrame, tz: str = "UTC", only: Collection[str] | None = None) -> DataFrame:
    """Raw orders to the columns of the table; row by row, no shuffle.

    The hour is a step of its own, so that the columns on top of it do not
    repeat it. The two booleans become 0/1 in place. `only` names the columns
    that are wanted, for orders that lack what others need.
    """
    wanted = set(NEEDS) if only is None else NEEDS.keys() & set(only)
    if wanted & {"hour_of_day", "is_peak_hour"}:
        orders = orders.withColumn("hour_of_day", oc.hour_of_day(F.col("timestamp"), tz))
    computed = {name: column() for name, column in _COMPUTED.items() if name in wanted}
    flags = {name: oc.flag(F.col(name)) for name in FLAGS if name in orders.columns}
    return orders.withColumns(computed | flags) if computed or flags else orders
