"""Topics on Kafka.

The options are plain dicts so that they can be looked at without a broker.
Reading and writing need the `spark-sql-kafka-0-10` package on the classpath.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

#: Messages in a micro-batch, some; the commands have it as a default.
BATCH_MESSAGES = 20_000_000


def source_options(
    servers: str,
    topic: str,
    starting_offsets: str = "latest",
    fail_on_data_loss: bool = False,
    max_offsets_per_trigger: int | None = None,
    min_offsets_per_trigger: int | None = None,
    max_trigger_delay: str | None = None,
    starting_ms: int | None = None,
    min_partitions: int | None = None,
    more: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; `more` holds any others, such as `kafka.security.protocol`.

    `max_offsets_per_trigger` bounds a micro-batch after a long pause, and
    `min_partitions` splits a topic partition that holds most of the messages.
    With `min_offsets_per_trigger` a batch waits until so many messages are
    there, but no longer than `max_trigger_delay` (such as "1h"). `starting_ms`
    starts a query without a checkpoint at a time, in epoch milliseconds, in
    place of `starting_offsets`; a partition without later messages starts at
    its end.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets if starting_ms is None else None,
        "startingTimestamp": starting_ms,
        "startingOffsetsByTimestampStrategy": None if starting_ms is None else "latest",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
        "maxOffsetsPerTrigger": max_offsets_per_trigger,
        "minOffsetsPerTrigger": min_offsets_per_trigger,
        "maxTriggerDelay": max_trigger_delay,
        "minPartitions": min_partitions,
    }
    return _texts(options | (more or {}))


def sink_options(
    servers: str, topic: str, acks: str = "all", retries: int = 3, more: dict[str, str] | None = None
) -> dict[str, str]:
    """Writer options, with acknowledgement by every replica."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": acks, "kafka.retries": retries}
    return _texts(options | (more or {}))


def _texts(options: dict) -> dict[str, str]:
    return {name: str(value) for name, value in options.items() if value is not None}


def stream_topic(spark: SparkSession, **options) -> DataFrame:
    """Messages as they arrive; see `source_options`."""
    return spark.readStream.format("kafka").options(**source_options(**options)).load()


def read_topic(spark: SparkSession, **options) -> DataFrame:
    """All messages that the topic holds now; a batch cannot start at 'latest'."""
    options = {"starting_offsets": "earliest"} | options
    return spark.read.format("kafka").options(**source_options(**options)).load()


def publish(messages: DataFrame, **options) -> None:
    """Send a batch of (key, value) messages; see `sink_options`."""
    messages.write.format("kafka").options(**sink_options(**options)).save()


def stream_writer(messages: DataFrame, **options) -> DataStreamWriter:
    """A writer that sends a stream of (key, value) messages."""
    return messages.writeStream.format("kafka").outputMode("append").options(**sink_options(**options))
