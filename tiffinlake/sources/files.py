"""Topics as directories of Parquet files with the key and value of a message.

They stand in for Kafka wherever no broker is at hand, and keep what text
files would lose: keys, null values and line breaks within a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tiffinlake import schema
from tiffinlake.session import exists


COMPRESSION = "zstd"  # JSON text takes half the room that it takes with snappy
#: Bytes of files in a micro-batch, some: a job that dies after hours has lost
#: one batch and not everything.
BATCH_BYTES = 4 << 30


def publish(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Add messages to a topic.

    Not to one that a stream writes: readers take the files that the stream's
    log names, and would never see these.
    """
    if exists(messages.sparkSession, f"{path}/_spark_metadata"):
        raise ValueError(f"{path} is written by a stream; publish to a topic of its own")
    messages.write.mode(mode).option("compression", COMPRESSION).parquet(path)


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MESSAGE).parquet(path)


def _arrived_ms() -> Column:
    """When the file of a message was written, in epoch milliseconds."""
    return F.unix_millis("_metadata.file_modification_time")


def arrived_since(spark: SparkSession, path: str, after_ms: int) -> tuple[int, int | None]:
    """How many messages came after a time, and when the first of them did.

    Files are counted by their footers; older ones are not opened.
    """
    if not exists(spark, path):
        return 0, None
    later = read_topic(spark, path).where(_arrived_ms() > after_ms)
    return tuple(later.agg(F.count(F.lit(1)), F.min(_arrived_ms())).first())


def stream_topic(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    starting_ms: int | None = None,
) -> DataFrame:
    """Messages of the files in `path`, and of those that are added to it.

    With `starting_ms` only those of files written at that time or later, in
    epoch milliseconds.
    """
    reader = spark.readStream.schema(schema.MESSAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    messages = reader.parquet(path)
    return messages if starting_ms is None else messages.where(_arrived_ms() >= starting_ms)


def stream_writer(messages: DataFrame, path: str, retention: str | None = None) -> DataStreamWriter:
    """A writer that adds a stream of messages to a topic, each exactly once.

    `retention` (such as "2h") hides files from readers that were committed
    longer ago than that.
    """
    writer = messages.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("compression", COMPRESSION)
    return writer.option("retention", retention) if retention else writer
