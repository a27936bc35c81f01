"""What streams report of each batch, kept as a table that reports can be made of."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = """
    query_id STRING, run_id STRING, name STRING, batch BIGINT, started STRING, input_rows BIGINT,
    input_rows_per_second DOUBLE, processed_rows_per_second DOUBLE, batch_ms BIGINT, trigger_ms BIGINT,
    behind BIGINT, state_rows BIGINT, state_bytes BIGINT, late_rows BIGINT
"""


def row_of(progress) -> tuple:
    """One row of `SCHEMA` from what a query says of a batch.

    `behind` is how many messages were left in the sources, for those that say
    so, as Kafka does.
    """
    told = json.loads(progress.json)
    behind = [int(s["metrics"]["maxOffsetsBehindLatest"]) for s in told["sources"] if "maxOffsetsBehindLatest" in (s.get("metrics") or {})]
    states = told.get("stateOperators") or []
    duration = told.get("durationMs") or {}
    return (
        told["id"], told["runId"], told.get("name"), told["batchId"], told["timestamp"], told.get("numInputRows", 0),
        _number(told.get("inputRowsPerSecond")), _number(told.get("processedRowsPerSecond")), duration.get("addBatch"), duration.get("triggerExecution"),
        max(behind) if behind else None, *(sum(s.get(k, 0) for s in states) if states else None for k in ("numRowsTotal", "memoryUsedBytes", "numRowsDroppedByWatermark")),
    )


def _number(value) -> float | None:
    return None if value is None or value != value or value in (float("inf"), "NaN") else float(value)


class ProgressLog(StreamingQueryListener):
    """Writes a row per batch of the session's queries to the table at `path`.

    Rows are gathered and written together, `rows` at a time and when a query
    ends. Batches without rows are left out: an idle stream writes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 100):
        self.spark, self.path, self.rows = spark, path, rows
        self._waiting: list[tuple] = []
        self._lock, self._begun, self._ended = threading.Lock(), set(), set()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)
        self.write()

    def onQueryStarted(self, event) -> None:
        # Told before the query's start returns.
        self._begun.add(str(event.runId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            with self._lock:
                self._waiting.append(row_of(event.progress))
                full = len(self._waiting) >= self.rows
            if full:
                self.write()

    def onQueryTerminated(self, event) -> None:
        self.write()
        self._ended.add(str(event.runId))

    def wait_for_all(self, seconds: float = 60) -> None:
        """Until all that the ended queries said has been written: a listener is told a little later than they end."""
        until = time.monotonic() + seconds
        while self._begun - self._ended:
            if time.monotonic() > until:
                raise TimeoutError(f"nothing was heard of the end of {self._begun - self._ended}")
            time.sleep(0.05)

    def write(self) -> None:
        with self._lock:
            rows, self._waiting = self._waiting, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Every batch once; one that was repeated after a failure counts by its last run."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    values = [c for c in rows.columns if c not in ("query_id", "batch")]
    last = F.max_by(F.struct(*values), "started").alias("last")
    return rows.groupBy("query_id", "batch").agg(last).select("query_id", "batch", "last.*").select(*rows.columns)


def totals(progress: DataFrame) -> DataFrame:
    """Per query: batches, rows, the longest batch, and how far behind the last one was."""
    return progress.groupBy("query_id", "name").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.max("trigger_ms").alias("longest_ms"),
        F.max_by("behind", "batch").alias("behind"),
    )
