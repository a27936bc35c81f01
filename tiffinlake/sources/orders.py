"""Orders derived from the tables of a star schema.

An order is one row of `events`; `customer` and `nation` say who ordered and
where, `part` stands for the restaurant. Callers name the columns they read.
Catalyst would prune an unused column by itself, but not a join: a dimension
is joined only if one of its columns is wanted. That is exact, as the joins
are left joins on a primary key and never change the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.functions import picks

# What is read of the tables. `ts` is stored without a zone; reading it as an
# instant takes it as UTC, whatever the session zone is.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey BIGINT, c_mktsegment STRING",
    "nation": "n_nationkey BIGINT, n_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
}

STATUS_OF_EVENT = {
    "purchase": "delivered",
    "view": "placed",
    "click": "preparing",
    "signup": "out_for_delivery",
}
OTHER_STATUS = "cancelled"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def with_percentile(events: DataFrame) -> DataFrame:
    """Adds the number from 0 to 99 in the properties of an event.

    As a column of its own it is found once, and not by every branch of a case
    that compares it.
    """
    return events.withColumn("percentile", F.get_json_object("props", "$.k").try_cast("int"))


def _phone() -> Column:
    number = picks.spread(F.col("user_id"), 1_000_000).cast("string")
    return F.concat(F.lit("+91"), F.lpad(number, 10, "0"))


def _status() -> Column:
    case = F
    for event, status in STATUS_OF_EVENT.items():
        case = case.when(F.col("event_type") == event, status)
    return case.otherwise(OTHER_STATUS)


def _rating() -> Column:
    stars = picks.bounded_real(F.col("event_id"), *picks.RATING, places=1, multiplier=1)
    return F.when(F.col("event_type") == "purchase", stars)


FROM_EVENT: dict[str, Callable[[], Column]] = {
    "order_id": lambda: F.concat(F.lit("ord-"), F.lpad(F.col("event_id").cast("string"), 10, "0")),
    "timestamp": lambda: F.unix_millis("ts"),
    "customer_phone": _phone,
    "quantity": lambda: picks.bounded_int(F.col("event_id"), *picks.QUANTITY),
    "price": lambda: picks.bounded_real(F.col("event_id"), *picks.PRICE, places=2),
    "status": _status,
    "payment_method": lambda: picks.weighted_pick(F.col("percentile"), picks.PAYMENT_PERCENT),
    "delivery_time_mins": lambda: picks.bounded_int(F.col("event_id"), *picks.DELIVERY_MINUTES),
    "rating": _rating,
    "discount_applied": lambda: picks.one_in(F.col("user_id"), 2),
    "is_first_order": lambda: picks.one_in(F.col("event_id"), picks.FIRST_ORDER_PERCENT),
}
FROM_CUSTOMER: dict[str, Callable[[], Column]] = {
    "customer_name": lambda: F.col("c_name"),
    "city": lambda: F.col("n_name"),
    "area": lambda: F.col("c_mktsegment"),
}
FROM_RESTAURANT: dict[str, Callable[[], Column]] = {
    "restaurant_name": lambda: F.col("p_brand"),
    "cuisine": lambda: F.col("p_type"),
    "items": lambda: F.col("p_name"),
}
COLUMNS = FROM_EVENT | FROM_CUSTOMER | FROM_RESTAURANT


def computed(columns: Iterable[str]) -> list[Column]:
    """Expressions of order columns over events and the joined dimensions."""
    return [COLUMNS[name]().alias(name) for name in columns]


def with_customers(events: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds the customer and nation of `user_id`.

    The customers grow with the data, so there is no broadcast hint: Spark
    broadcasts them while their files are below its size threshold and else
    shuffles both sides, with AQE splitting the partition of a customer (or of
    a null key) that holds much of the orders. They are joined before the
    nations and not to them first, since Spark takes the size of a join for
    the product of its sides and would no longer see how small they are.
    """
    customer, nation = read(spark, folder, "customer"), read(spark, folder, "nation")
    placed = events.join(customer, F.col("user_id") == F.col("c_custkey"), "left")
    return placed.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")


def with_restaurants(events: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds the restaurant of `event_id`, which is that number modulo the number of parts.

    Every part is a restaurant, so they grow with the data and have no hint.
    """
    part = read(spark, folder, "part")
    parts = part.agg(F.count(F.lit(1))).scalar()
    key = F.when(parts > 0, F.pmod(F.col("event_id"), F.nullif(parts, F.lit(0).cast("bigint"))))
    return events.withColumn("part_key", key).join(part, F.col("part_key") == F.col("p_partkey"), "left")


def raw_orders(spark: SparkSession, folder: str, columns: Iterable[str] = schema.RAW_COLUMNS) -> DataFrame:
    """Orders with the columns of a raw order message, or some of them.

    The columns are computed after the joins: if the customers take a shuffle,
    it moves the short columns of the events and not the long ones of orders.
    """
    columns = list(columns)
    rows = read(spark, folder, "events")
    if "payment_method" in columns:
        rows = with_percentile(rows)
    if not FROM_CUSTOMER.keys().isdisjoint(columns):
        rows = with_customers(rows, spark, folder)
    if not FROM_RESTAURANT.keys().isdisjoint(columns):
        rows = with_restaurants(rows, spark, folder)
    return rows.select(computed(columns))
