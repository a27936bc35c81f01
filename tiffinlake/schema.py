"""Column sets, roles and null defaults of the order stream and its table.

Schemas are DDL strings: `from_json`, `spark.read.schema` and
`spark.readStream.schema` all accept them, and nothing is ever inferred.
"""

from __future__ import annotations

from collections.abc import Collection

# Names, types and order are the wire format of an order message.
RAW_ORDER = """
    order_id STRING, `timestamp` BIGINT, customer_name STRING,
    customer_phone STRING, city STRING, area STRING, restaurant_name STRING,
    cuisine STRING, items STRING, quantity INT, price FLOAT, status STRING,
    payment_method STRING, delivery_time_mins INT, rating FLOAT,
    discount_applied BOOLEAN, is_first_order BOOLEAN
"""

# The table has the raw columns, the two booleans as 0/1, and
# five computed columns.
FOOD_ORDERS = """
    order_id STRING, `timestamp` BIGINT, customer_name STRING,
    customer_phone STRING, city STRING, area STRING, restaurant_name STRING,
    cuisine STRING, items STRING, quantity INT, price FLOAT, status STRING,
    payment_method STRING, delivery_time_mins INT, rating FLOAT,
    discount_applied INT, is_first_order INT, hour_of_day INT,
    is_peak_hour INT, order_value_category STRING, price_per_item FLOAT,
    is_high_value INT
"""

# What a null metric is stored as.
METRIC_DEFAULTS = {
    "quantity": 0,
    "price": 0.0,
    "delivery_time_mins": 0,
    "rating": -1.0,
    "hour_of_day": 0,
    "is_peak_hour": 0,
    "price_per_item": 0.0,
    "is_high_value": 0,
    "discount_applied": 0,
    "is_first_order": 0,
}

TIME_COLUMN = "timestamp"  # epoch milliseconds

# The columns the table is meant to be filtered by. Rows of a file
# are sorted by the status, as the reports filter by it, and clustered by all.
INDEX_COLUMNS = ("status", "city", "cuisine", "payment_method", "order_value_category")

# The partition columns of the table on disk: the UTC date of a row's time, and
# who wrote it in which batch.
DATE_COLUMN = "order_date"
WRITER_COLUMN = "writer"
BATCH_COLUMN = "batch"
PARTITION_COLUMNS = (DATE_COLUMN, WRITER_COLUMN, BATCH_COLUMN)
FOOD_ORDERS_ON_DISK = f"{FOOD_ORDERS}, {DATE_COLUMN} DATE, {WRITER_COLUMN} STRING, {BATCH_COLUMN} BIGINT"

# A topic: what a message log holds, whether it is Kafka or a directory.
MESSAGE = "key BINARY, value BINARY"


def column_names(ddl: str) -> list[str]:
    """Names in a flat DDL string, in order."""
    return [field.split()[0].strip("`") for field in ddl.split(",")]


def subset(ddl: str, columns: Collection[str]) -> str:
    """The part of a flat DDL string that declares `columns`."""
    return ", ".join(field.strip() for field in ddl.split(",") if field.split()[0].strip("`") in columns)


RAW_COLUMNS = column_names(RAW_ORDER)
TABLE_COLUMNS = column_names(FOOD_ORDERS)
DIMENSIONS = [c for c in TABLE_COLUMNS if c not in METRIC_DEFAULTS and c != TIME_COLUMN]


def role(column: str) -> str:
    """'time', 'metric' or 'dimension'."""
    if column not in TABLE_COLUMNS:
        raise KeyError(column)
    if column == TIME_COLUMN:
        return "time"
    return "metric" if column in METRIC_DEFAULTS else "dimension"
