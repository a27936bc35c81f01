"""Live results kept by group: each batch writes the groups that it changed, and no others.

A result is a log of rows, each with the stream and batch that wrote it; the
newest row of a group is its value. A batch that is repeated replaces what it
wrote. Now and then the log is folded: the newest rows are written once more,
and what an earlier fold had covered is deleted. A row keeps its batch when it
is folded, so that a reader may see it twice without harm.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tiffinlake import schema
from tiffinlake.functions.order_columns import MS_PER_DAY
from tiffinlake.session import file_system, remove
from tiffinlake.streaming.jobs import start, stream_name

#: Batches between two folds.
FOLD_EVERY = 64
_STAMPS = "stream STRING, started BIGINT, batch BIGINT"
#: The grain of the reports over the last day.
GRAIN_MS = 60_000


def newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each group in a log; of equal ones any."""
    values = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct("started", "batch")).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, "last.*")


def start_changes(
    report: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    fold_every: int = FOLD_EVERY,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **trigger,
) -> StreamingQuery:
    """Keep a grouped aggregate over a stream, of the session that `jobs.live_session` gives.

    The state holds the groups, in files on the executors' disks and their
    changes in the checkpoint, so that it may outgrow memory; a batch writes the
    groups it changed. `keys` name a group. `keep` is applied when the log is
    folded and drops groups that no reader asks for any more.
    """
    spark = report.sparkSession
    stream, started = stream_name(spark, checkpoint), time.time_ns()
    own = f"{path}/{stream}"
    columns = StructType([*report.schema.fields, *StructType.fromDDL(_STAMPS).fields])

    def save(changed: DataFrame, batch: int) -> None:
        stamped = changed.withColumns(
            {"stream": F.lit(stream), "started": F.lit(started), "batch": F.lit(batch).cast("bigint")}
        )
        stamped.write.mode("overwrite").parquet(f"{own}/batch-{batch}")
        if batch % fold_every == fold_every - 1:
            _fold(changed.sparkSession, own, batch, fold_every, keys, columns, keep)

    return start(report.writeStream.outputMode("update").foreachBatch(save), checkpoint, **trigger)


def _fold(spark: SparkSession, own: str, batch: int, every: int, keys: Sequence[str], columns: StructType, keep: Callable) -> None:
    log = spark.read.schema(columns).parquet(f"{own}/*")
    keep(newest(log, keys)).select(*columns.names).write.mode("overwrite").parquet(f"{own}/fold-{batch}")
    # What the last fold covered; readers of what this one covers may not have finished.
    covered = batch - every
    fs, place = file_system(spark, f"{own}/*")
    for status in fs.globStatus(place) or []:
        kind, _, number = status.getPath().getName().partition("-")
        if int(number) <= covered - (kind == "fold"):
            remove(spark, status.getPath().toString())


def read_changes(spark: SparkSession, path: str, report: StructType | str, keys: Sequence[str]) -> DataFrame:
    """Every group of the newest stream that wrote to `path`, with the schema `report`."""
    columns = StructType.fromDDL(report) if isinstance(report, str) else report
    stamps = StructType.fromDDL(_STAMPS)
    log = spark.read.schema(StructType([*columns.fields, *stamps.fields])).parquet(f"{path}/*/*")
    last = log.agg(F.max(F.struct("started", "stream")).alias("last")).select("last.stream").scalar()
    return newest(log.where(F.col("stream") == last), keys).select(*columns.names)


# --- the last day ------------------------------------------------------------


def orders_per_minute(orders: DataFrame, now_ms=None) -> DataFrame:
    """(minute, orders) of a stream with `timestamp`, for the last day only; a minute is its first millisecond.

    State goes a day after the newest order. Orders without a time, and those
    dated later than now, do not count: one from the year 9999 would end the
    report for all others.
    """
    time_ms = F.col(schema.TIME_COLUMN)
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    placed = orders.where(time_ms <= now).withColumn("placed", F.timestamp_millis(time_ms))
    minute = F.window("placed", f"{GRAIN_MS} milliseconds")
    counts = placed.withWatermark("placed", f"{MS_PER_DAY} milliseconds").groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("orders"))
    return counts.select(F.unix_millis("minute.start").alias("minute"), "orders")


def last_day(minutes: DataFrame) -> DataFrame:
    """The minutes of the day that ends with the newest one."""
    newest_minute = minutes.agg(F.max("minute")).scalar()
    return minutes.where(F.col("minute") > newest_minute - MS_PER_DAY)
