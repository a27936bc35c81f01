"""Ad-hoc SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiffinlake.operators.table import register_view


def run_sql(spark: SparkSession, text: str, orders: DataFrame | None = None, name: str = "food_orders") -> DataFrame:
    """Any Spark SQL; `orders` becomes the view `name` first if it is given."""
    if orders is not None:
        register_view(orders, name)
    return spark.sql(text)
