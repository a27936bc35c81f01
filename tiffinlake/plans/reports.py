"""The business reports.

Each takes a DataFrame with the columns it names, be it the stored table or a
plan that still derives it, and returns a plan. Grouped reports shuffle only
the partial sums of the groups, so a group that holds most of the rows costs
no more than any other, and each reads its input once. Reports that cut at a
limit break ties by a unique column.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.functions import order_columns
from tiffinlake.operators.table import retain
from tiffinlake.session import scratch_dir

TOP = 10


def count() -> Column:
    return F.count(F.lit(1))


def total(column: str = "price") -> Column:
    """A sum to the cent, whatever the order it is summed in.

    It is one of decimals: a double would step in eighths beyond 10^15. A price
    that is not a number, or of more than 16 digits, adds nothing.
    """
    return F.sum(F.col(column).try_cast("decimal(18,2)")).cast("double")


def mean(column: str = "price", places: int = 2) -> Column:
    return F.round(F.avg(column), places)


def running_totals(orders: DataFrame) -> DataFrame:
    """One row; also on a stream."""
    return orders.agg(count().alias("total_orders"), total().alias("total_revenue"))


def totals(orders: DataFrame) -> DataFrame:
    """All orders and their revenue."""
    return running_totals(orders).limit(1)


def running_totals_by_order(orders: DataFrame) -> DataFrame:
    """For each order, the orders and the revenue up to it; in order of time, then of the id, nulls first.

    Sums over all that came before, without gathering anything in one task:
    rows are range-partitioned in that order and kept as a table with the number
    of their range; the sums of the ranges, one row each, are added up to what
    each range starts from, and the rest is a running sum within a range. The
    id is unique, so that a moment that holds most of the orders is split too.
    The revenue is one of decimals to the cent, as everywhere.
    """
    spark = orders.sparkSession
    in_order = [F.col(c).asc_nulls_first() for c in (schema.TIME_COLUMN, "order_id")]
    cents = F.coalesce(F.col("price").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    ranged = orders.select("order_id", schema.TIME_COLUMN, cents.alias("amount")).repartitionByRange(*in_order)
    # Ranges are drawn from a sample; kept, they are the same for sums and rows.
    path = scratch_dir(spark, "ranges")
    ranged.withColumn("range", F.spark_partition_id()).sortWithinPartitions(*in_order).write.parquet(path)
    kept = spark.read.parquet(path)
    sums = kept.groupBy("range").agg(count().alias("orders"), F.sum("amount").cast("decimal(38,2)").alias("amount")).orderBy("range").collect()
    with localcontext(prec=40):
        before = list(accumulate(sums, lambda so_far, r: (so_far[0] + r.orders, so_far[1] + r.amount), initial=(0, Decimal(0))))
    offsets = spark.createDataFrame(
        [(r.range, orders, amount) for r, (orders, amount) in zip(sums, before)],
        "range INT, orders_before BIGINT, amount_before DECIMAL(38,2)",
    )
    within = Window.partitionBy("range").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = kept.withColumns({"orders": count().over(within), "amount": F.sum("amount").over(within)})
    # One row a range: as many as the shuffle has partitions.
    return so_far.join(F.broadcast(offsets), "range").select(
        "order_id",
        schema.TIME_COLUMN,
        (F.col("orders") + F.col("orders_before")).alias("total_orders"),
        (F.col("amount") + F.col("amount_before")).cast("double").alias("total_revenue"),
    )


def by_city(orders: DataFrame) -> DataFrame:
    """Every city, unsorted; also on a stream."""
    return orders.groupBy("city").agg(
        count().alias("orders"), total().alias("revenue"), mean().alias("avg_order_value")
    )


def city_revenue(orders: DataFrame, limit: int = TOP) -> DataFrame:
    """The cities with the highest revenue."""
    return by_city(orders).orderBy(F.desc("revenue"), "city").limit(limit)


def cuisine_popularity(orders: DataFrame) -> DataFrame:
    """Cuisines by number of orders."""
    report = orders.groupBy("cuisine").agg(count().alias("orders"), mean().alias("avg_price"))
    return report.orderBy(F.desc("orders"))


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status; also on a stream."""
    return orders.groupBy("status").agg(count().alias("count"))


def status_share(orders: DataFrame) -> DataFrame:
    """Orders per status and their percentage of all orders."""
    return share_of_counts(status_counts(orders))


def share_of_counts(counts: DataFrame) -> DataFrame:
    """The percentage of each count.

    The grand total is a scalar subquery over the grouped counts, for which
    Spark reuses the shuffle of the groups. A window without partitions says
    the same but would move all groups into one task, and statuses come from
    messages, so nothing bounds their number.
    """
    everything = counts.agg(F.sum("count")).scalar()
    share = F.round(F.col("count").cast("double") * 100 / everything, 2)
    return counts.select("status", "count", share.alias("pct")).orderBy(F.desc("count"))


def payment_mix(orders: DataFrame) -> DataFrame:
    """Payment methods by number of orders."""
    report = orders.groupBy("payment_method").agg(count().alias("orders"), total().alias("total_revenue"))
    return report.orderBy(F.desc("orders"))


def peak_comparison(orders: DataFrame) -> DataFrame:
    """Peak hours against the rest of the day."""
    return orders.groupBy("is_peak_hour").agg(
        count().alias("orders"),
        mean().alias("avg_price"),
        mean("delivery_time_mins", 1).alias("avg_delivery_mins"),
    )


def by_restaurant(orders: DataFrame) -> DataFrame:
    """Delivered orders of every restaurant, unsorted; also on a stream."""
    delivered = orders.where(F.col("status") == "delivered").groupBy("restaurant_name")
    return delivered.agg(count().alias("orders"), total().alias("total_revenue"), mean("rating").alias("avg_rating"))


def top_by_revenue(restaurants: DataFrame, limit: int = TOP) -> DataFrame:
    """The first of the restaurants that `by_restaurant` gives."""
    return restaurants.orderBy(F.desc("total_revenue"), "restaurant_name").limit(limit)


def top_restaurants(orders: DataFrame, limit: int = TOP) -> DataFrame:
    """The restaurants with the highest delivered revenue."""
    return top_by_revenue(by_restaurant(orders), limit)


def value_categories(orders: DataFrame) -> DataFrame:
    """Price tiers, the dearest first."""
    report = orders.groupBy("order_value_category").agg(count().alias("orders"), mean().alias("avg_price"))
    return report.orderBy(F.desc("avg_price"))


def hourly_volume(orders: DataFrame) -> DataFrame:
    """Orders per hour of the day, over whatever the table holds."""
    return orders.groupBy("hour_of_day").agg(count().alias("orders")).orderBy("hour_of_day")


def hours_of_minutes(minutes: DataFrame) -> DataFrame:
    """Orders per hour of the day, from counts of minutes that begin at epoch milliseconds `minute`."""
    hour = order_columns.hour_of_day(F.col("minute"))
    return minutes.groupBy(hour.alias("hour_of_day")).agg(F.sum("orders").alias("orders")).orderBy("hour_of_day")


def hourly_volume_last_day(orders: DataFrame, as_of_ms: int | Column) -> DataFrame:
    """Orders per hour of the day, over the 24 hours up to `as_of_ms`; later ones do not count."""
    return hourly_volume(retain(orders, as_of_ms).where(F.col(schema.TIME_COLUMN) <= as_of_ms))


def dearest_delivered(orders: DataFrame, limit: int = TOP) -> DataFrame:
    """The highest-priced delivered orders of high value, whole rows."""
    wanted = (F.col("is_high_value") == 1) & (F.col("status") == "delivered")
    return orders.where(wanted).orderBy(F.desc("price"), "order_id").limit(limit)


HIGH_VALUE_COLUMNS = ("restaurant_name", "city", "cuisine", "price", "rating")


def high_value_orders(orders: DataFrame, limit: int = TOP) -> DataFrame:
    """The highest-priced delivered orders with their ratings."""
    return dearest_delivered(orders, limit).select(*HIGH_VALUE_COLUMNS)


# The columns that each report reads.
READS = {
    running_totals: ("price",),
    totals: ("price",),
    running_totals_by_order: ("order_id", "timestamp", "price"),
    by_city: ("city", "price"),
    city_revenue: ("city", "price"),
    cuisine_popularity: ("cuisine", "price"),
    status_share: ("status",),
    status_counts: ("status",),
    payment_mix: ("payment_method", "price"),
    peak_comparison: ("is_peak_hour", "price", "delivery_time_mins"),
    by_restaurant: ("restaurant_name", "status", "price", "rating"),
    top_restaurants: ("restaurant_name", "status", "price", "rating"),
    value_categories: ("order_value_category", "price"),
    hourly_volume: ("hour_of_day",),
    hourly_volume_last_day: ("timestamp", "hour_of_day"),
    high_value_orders: (*HIGH_VALUE_COLUMNS, "order_id", "status", "is_high_value"),
}
