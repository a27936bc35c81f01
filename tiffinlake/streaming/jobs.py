"""Streaming jobs: enrichment, ingestion into the table, live aggregates.

The plans are those of the batch operators. Sources and sinks are passed in,
so that the same job runs on Kafka and on directories of files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tiffinlake.operators.codec import decode, encode
from tiffinlake.operators.enrich import enrich, raw_columns
from tiffinlake.operators.table import add_batch, conform, write_table
from tiffinlake.session import exists


def enriched_messages(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """Raw messages to messages of enriched orders, one for one."""
    return encode(enrich(decode(raw), tz))


def start(
    writer: DataStreamWriter,
    checkpoint: str,
    available_now: bool = False,
    interval: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start a query; without a trigger it runs batch after batch.

    `available_now` takes what is there and ends, `interval` (such as
    "1 hour") is the time between two batches. The checkpoint must lie on
    shared storage: a restart on any machine goes on from it.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    if name:
        writer = writer.queryName(name)
    return writer.start()


def start_enrichment(
    raw: DataFrame,
    sink: Callable[[DataFrame], DataStreamWriter],
    checkpoint: str,
    tz: str = "UTC",
    **trigger,
) -> StreamingQuery:
    """Raw topic to processed topic; append only, no state and no shuffle."""
    return start(sink(enriched_messages(raw, tz)), checkpoint, **trigger)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint does, kept beside its own files."""
    place = f"{checkpoint}/stream_name"
    if not exists(spark, f"{place}/_SUCCESS"):
        spark.createDataFrame([(f"stream-{uuid.uuid4().hex}",)], "value STRING").coalesce(1).write.mode("overwrite").text(place)
    return spark.read.text(place).first()[0]


def without_repeats(messages: DataFrame, within: str) -> DataFrame:
    """A stream of messages without those that have come before, no longer ago than `within` (such as "1 hour").

    A producer that is not answered sends again what may have arrived. A message
    is known by its key, the id of its order, or without a key by its value.
    Time is that of arrival: nothing is ever too late, and what is forgotten
    after a while lets a repetition through but loses no message.
    """
    marked = messages.select(
        "*",
        F.coalesce("key", "value").alias("_identity"),
        F.col("key").isNull().alias("_keyless"),
        F.current_timestamp().alias("_arrived"),
    )
    once = marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_identity", "_keyless"])
    return once.drop("_identity", "_keyless", "_arrived")


def start_ingestion(
    processed: DataFrame,
    path: str,
    checkpoint: str,
    dimension_default: str | None = None,
    rebalance: bool = False,
    max_records_per_file: int | None = None,
    row_group_bytes: int | None = None,
    repeats_within: str | None = None,
    catalog_name: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Processed topic to the table at `path`.

    Each batch is a batch of the table, by the name of the stream that the
    checkpoint keeps, and a repetition replaces it: rows arrive exactly once,
    without a log of files that grows for ever, and expired days can be deleted
    while the stream goes on. Another stream, or the same with a new
    checkpoint, is another writer and replaces nothing. `interval` is the time
    threshold of a flush, `max_records_per_file` bounds a file; for a flush after
    so many rows see `flush_when`, or `min_offsets_per_trigger` on Kafka.

    With `repeats_within` messages that a producer repeated within that time
    count once; `live_session` gives a session for the state. Batches of a table
    that is registered as `catalog_name` are made known there as they are written.
    """
    writer = stream_name(processed.sparkSession, checkpoint)

    def save(rows: DataFrame, batch: int) -> None:
        write_table(rows, path, batch, writer, rebalance, max_records_per_file, row_group_bytes)
        if catalog_name:
            add_batch(rows.sparkSession, path, catalog_name, batch, writer)

    messages = without_repeats(processed, repeats_within) if repeats_within else processed
    return start(conform(messages, dimension_default).writeStream.foreachBatch(save), checkpoint, **trigger)


def flush_when(
    pending: Callable[[int], tuple[int, int | None]],
    begin: Callable[[], StreamingQuery],
    mark: str,
    rows: int,
    after_s: float,
    poll_s: float = 5.0,
    ended: Callable[[], bool] = lambda: False,
    spark: SparkSession | None = None,
) -> int:
    """Run a query whenever `rows` messages wait, or one has waited for `after_s` seconds; returns how often it ran.

    `pending` gives how many messages came after a time in epoch milliseconds,
    and when the first of them did; `begin` starts a query that takes what is
    there and ends. The time up to which all is taken is kept at `mark`, a
    folder beside the checkpoint, so that waiting goes on after a restart. It
    decides only when a query runs: what it takes is the checkpoint's to know.
    """
    spark = spark or SparkSession.active()
    taken, runs = _read_mark(spark, mark), 0
    while not ended():
        now = time.time_ns() // 1_000_000
        waiting, first = pending(taken)
        if waiting >= rows or (waiting and first is not None and now - first >= after_s * 1000):
            run_to_end(begin())
            taken, runs = now, runs + 1
            spark.createDataFrame([(str(taken),)], "value STRING").coalesce(1).write.mode("overwrite").text(mark)
        else:
            time.sleep(poll_s)
    return runs


def _read_mark(spark: SparkSession, mark: str) -> int:
    return int(spark.read.text(mark).first()[0]) if exists(spark, f"{mark}/_SUCCESS") else -1


LIVE_SLOTS = 4
STATE_PARTITIONS = 8
# State on disk, not on the heap, so that it may have more groups than fit; a
# batch puts its changes into the checkpoint and not all of the state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def live_orders(raw: DataFrame, columns: Collection[str], tz: str = "UTC") -> DataFrame:
    """Some columns of enriched orders out of raw messages."""
    return enrich(decode(raw, columns=raw_columns(columns)), tz, only=columns)


def live_session(spark: SparkSession, partitions: int = STATE_PARTITIONS) -> SparkSession:
    """A session for streams with state, of so many partitions, kept by RocksDB.

    Groups of a report are few, and each task sends one partial row of each: a
    state store per shuffle partition of a large job would be far too many.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", partitions)
    for key, value in STATE_STORE.items():
        own.conf.set(key, value)
    return own


def start_live(
    report: DataFrame,
    path: str,
    checkpoint: str,
    finish: Callable[[DataFrame], DataFrame] = lambda result: result,
    **trigger,
) -> StreamingQuery:
    """Keep an aggregate over a stream; each batch writes its whole result.

    The last few results are kept, in folders that are used in turn: a query
    that never ends takes no more room, a reader has time to finish, and a
    repeated batch overwrites what it left. Results say when their query was
    started, so that one that starts anew is not hidden by what an older one
    left. `finish` is a step over the groups that a stream cannot take.
    """
    started = time.time_ns()

    def save(result: DataFrame, batch: int) -> None:
        stamped = finish(result).withColumns({"started": F.lit(started), "batch": F.lit(batch).cast("bigint")})
        stamped.write.mode("overwrite").parquet(f"{path}/slot={batch % LIVE_SLOTS}")

    return start(report.writeStream.outputMode("complete").foreachBatch(save), checkpoint, **trigger)


def read_live(spark: SparkSession, path: str, report: StructType | str) -> DataFrame:
    """The newest result of a live aggregate with the schema `report`, every group of it."""
    columns = StructType.fromDDL(report) if isinstance(report, str) else report
    stamps = StructType.fromDDL("started BIGINT, batch BIGINT, slot INT")
    results = spark.read.schema(StructType([*columns.fields, *stamps.fields])).parquet(path)
    last = results.agg(F.max(F.struct("started", "batch"))).scalar()
    return results.where(F.struct("started", "batch") == last).select(*columns.names)


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query; its failure is raised here, and whatever ends the wait ends the query."""
    try:
        query.awaitTermination()
    finally:
        if query.isActive:
            query.stop()
    return query
