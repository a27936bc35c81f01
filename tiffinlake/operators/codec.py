"""Messages to rows and back."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffinlake import schema


def decode(messages: DataFrame, ddl: str = schema.RAW_ORDER, columns: Collection[str] | None = None) -> DataFrame:
    """One row per message, with the columns of `ddl` or some of them.

    Who reads two columns should name them: the parser then skips the rest,
    which Catalyst brings about for a single column only.

    Nothing is dropped: a value that is no JSON object gives a row of nulls, a
    field of the wrong type a null in that column, and unknown fields are
    left out.
    """
    if columns is not None:
        ddl = schema.subset(ddl, columns)
    text = F.col("value").cast("string")
    return messages.select(F.from_json(text, ddl).alias("message")).select("message.*")


def encode(rows: DataFrame, key: str = "order_id", keep_nulls: bool = False) -> DataFrame:
    """The (key, value) envelope; null fields are left out unless kept."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    return rows.select(
        F.col(key).cast("binary").alias("key"),
        F.to_json(F.struct("*"), options).cast("binary").alias("value"),
    )
