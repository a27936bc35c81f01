"""Commands for spark-submit.

A topic is given as `kafka:host:port[,host:port]/topic` or as a directory.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tiffinlake import schema
from tiffinlake.operators import table
from tiffinlake.operators.codec import encode
from tiffinlake.plans import reports
from tiffinlake.plans.sql import run_sql
from tiffinlake.session import build_session
from tiffinlake.sources import files, kafka, orders
from tiffinlake.streaming import changes, jobs, progress

REPORTS = {
    "totals": reports.totals,
    "city-revenue": reports.city_revenue,
    "cuisines": reports.cuisine_popularity,
    "status": reports.status_share,
    "payments": reports.payment_mix,
    "peak": reports.peak_comparison,
    "restaurants": reports.top_restaurants,
    "values": reports.value_categories,
    "hours": reports.hourly_volume,
    "hours-last-day": reports.hourly_volume_last_day,
    "high-value": reports.high_value_orders,
}
# A report, and what is left to do in each batch's result.
LIVE = {
    "totals": (reports.running_totals, None),
    "city-revenue": (reports.by_city, None),
    "cuisines": (reports.cuisine_popularity, None),
    "status": (reports.status_counts, reports.share_of_counts),
    "payments": (reports.payment_mix, None),
    "peak": (reports.peak_comparison, None),
    "restaurants": (reports.top_restaurants, None),
    "values": (reports.value_categories, None),
    "hours": (reports.hourly_volume, None),
}
# Reports whose batches write the groups that they changed: the columns they read, the groups, what names one, what is kept.
CHANGES = {
    "all-cities": (reports.READS[reports.by_city], reports.by_city, ["city"], lambda rows: rows),
    "all-restaurants": (reports.READS[reports.by_restaurant], reports.by_restaurant, ["restaurant_name"], lambda rows: rows),
    "minutes-last-day": ((schema.TIME_COLUMN,), changes.orders_per_minute, ["minute"], changes.last_day),
}


def kafka_place(topic: str) -> dict[str, str] | None:
    """Servers and topic of a Kafka topic; None for a directory."""
    if not topic.startswith("kafka:"):
        return None
    servers, _, name = topic.removeprefix("kafka:").rpartition("/")
    if not servers or not name:
        raise ValueError(f"expected kafka:host:port/topic, not {topic}")
    return {"servers": servers, "topic": name}


def kafka_options(args: argparse.Namespace) -> dict[str, str]:
    """Further options of the connector, given as key=value: security, for one."""
    return dict(option.split("=", 1) for option in args.kafka_option or ())


def stream_from(spark: SparkSession, args: argparse.Namespace, starting_offsets: str) -> DataFrame:
    place = kafka_place(args.input)
    if place:
        return kafka.stream_topic(
            spark,
            **place,
            starting_offsets=args.offsets or starting_offsets,
            max_offsets_per_trigger=args.max_offsets,
            min_offsets_per_trigger=args.min_offsets,
            max_trigger_delay=args.max_delay,
            starting_ms=args.start_ms,
            min_partitions=args.min_partitions,
            more=kafka_options(args),
        )
    return files.stream_topic(spark, args.input, max_bytes_per_trigger=args.max_bytes, starting_ms=args.start_ms)


def stream_to(messages: DataFrame, args: argparse.Namespace) -> DataStreamWriter:
    place = kafka_place(args.output)
    if place:
        return kafka.stream_writer(messages, **place, more=kafka_options(args))
    return files.stream_writer(messages, args.output)


def publish(spark: SparkSession, args: argparse.Namespace) -> None:
    """Orders derived from tables, to a raw topic."""
    messages = encode(orders.raw_orders(spark, args.tables), keep_nulls=True)
    place = kafka_place(args.output)
    if place:
        kafka.publish(messages, **place)
    else:
        files.publish(messages, args.output)


def _trigger(args: argparse.Namespace) -> dict:
    return {"available_now": args.once, "interval": args.interval}


def _run(spark: SparkSession, args: argparse.Namespace, begin: Callable[[], StreamingQuery]) -> None:
    """Run a query to its end; with --progress, what its batches report is added to that table."""
    if not args.progress:
        jobs.run_to_end(begin())
        return
    with progress.ProgressLog(spark, args.progress) as log:
        jobs.run_to_end(begin())
        log.wait_for_all()


def enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    """Raw topic to processed topic."""
    raw = stream_from(spark, args, "latest")
    _run(spark, args, lambda: jobs.start_enrichment(
        raw, lambda m: stream_to(m, args), args.checkpoint, args.tz, **_trigger(args)
    ))


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Processed topic to the table."""
    session = jobs.live_session(spark, args.state_partitions) if args.repeats_within else spark
    if args.name:
        table.create_table(session, args.table, args.name)

    def begin(**trigger) -> StreamingQuery:
        return jobs.start_ingestion(
            stream_from(session, args, "earliest"),
            args.table,
            args.checkpoint,
            args.dimension_default,
            args.rebalance,
            args.max_records_per_file,
            args.row_group_bytes,
            args.repeats_within,
            args.name,
            **(trigger or _trigger(args)),
        )

    if args.flush_rows and not kafka_place(args.input):
        pending = lambda since: files.arrived_since(spark, args.input, since)
        mark = f"{args.checkpoint}/flushed"
        jobs.flush_when(pending, lambda: begin(available_now=True), mark, args.flush_rows, args.flush_seconds, spark=spark)
    else:
        _run(session, args, begin)


def live(spark: SparkSession, args: argparse.Namespace) -> None:
    """A report kept up to date over the raw topic."""
    session = jobs.live_session(spark, args.state_partitions)
    raw = stream_from(session, args, "latest")
    if args.name in CHANGES:
        read, report, keys, keep = CHANGES[args.name]
        orders_now = jobs.live_orders(raw, read, args.tz)
        _run(session, args, lambda: changes.start_changes(
            report(orders_now), args.output, args.checkpoint, keys, keep=keep, **_trigger(args)
        ))
        return
    report, finish = LIVE[args.name]
    orders_now = jobs.live_orders(raw, reports.READS[report], args.tz)
    more = {"finish": finish} if finish else {}
    _run(session, args, lambda: jobs.start_live(report(orders_now), args.output, args.checkpoint, **more, **_trigger(args)))


def give(result: DataFrame, args: argparse.Namespace, folder: str = "") -> None:
    """The whole result to --output, written by the executors; else the first --rows rows to the screen."""
    if args.output:
        result.write.mode("overwrite").parquet(args.output + folder)
        return
    shown = result.limit(args.rows + 1).collect()
    spark = result.sparkSession
    spark.createDataFrame(shown[: args.rows], result.schema).show(max(1, args.rows), truncate=False)
    if len(shown) > args.rows:
        print(f"There are more than these {args.rows} rows: --output FOLDER writes them all.")


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    """One or all of the reports over the table."""
    stored = table.read_table(spark, args.table)
    as_of_ms = time.time_ns() // 1_000_000 if args.as_of_ms is None else args.as_of_ms
    for name in [args.name] if args.name != "all" else REPORTS:
        print(name)
        options = {"as_of_ms": as_of_ms} if name == "hours-last-day" else {}
        give(REPORTS[name](stored, **options), args, f"/{name}" if args.name == "all" else "")


def sql(spark: SparkSession, args: argparse.Namespace) -> None:
    """Any SQL over the table, as the view food_orders."""
    give(run_sql(spark, args.text, table.read_table(spark, args.table)), args)


def register(spark: SparkSession, args: argparse.Namespace) -> None:
    """Enter the table in the catalog, or make its new batches known there."""
    print("created" if table.create_table(spark, args.table, args.name) else "brought up to date")


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    """Merge the small batches of each date."""
    print(table.compact(spark, args.table, args.least))


def expire(spark: SparkSession, args: argparse.Namespace) -> None:
    """Delete days before the retention period."""
    as_of_ms = time.time_ns() // 1_000_000 if args.as_of_ms is None else args.as_of_ms
    for day in table.drop_expired(spark, args.table, as_of_ms, args.days):
        print(day)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="job.py", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(run, *required: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        return sub

    def stream(run, *required: str) -> argparse.ArgumentParser:
        sub = command(run, "input", "checkpoint", *required)
        sub.add_argument("--offsets", help="where to start without a checkpoint: latest or earliest")
        sub.add_argument("--once", action="store_true", help="take what is there and end")
        sub.add_argument("--interval", help="time between two batches, such as '1 hour'")
        sub.add_argument("--tz", default="UTC", help="zone of the hour of the day")
        sub.add_argument("--start-ms", type=int, help="without a checkpoint, start with what came at this time in epoch milliseconds")
        sub.add_argument("--max-offsets", type=int, default=kafka.BATCH_MESSAGES, help="Kafka messages in a batch at most")
        sub.add_argument("--min-offsets", type=int, help="Kafka messages that a batch waits for")
        sub.add_argument("--max-delay", help="how long it waits for them, such as 1h")
        sub.add_argument("--max-bytes", type=int, default=files.BATCH_BYTES, help="bytes of files in a batch at most")
        sub.add_argument("--state-partitions", type=int, default=jobs.STATE_PARTITIONS)
        sub.add_argument("--progress", metavar="FOLDER", help="keep what each batch reports in a table")
        sub.add_argument("--min-partitions", type=int, help="tasks that read Kafka at least")
        sub.add_argument("--kafka-option", action="append", metavar="KEY=VALUE", help="more options of the connector")
        return sub

    def result(run, *required: str) -> argparse.ArgumentParser:
        sub = command(run, *required)
        sub.add_argument("--output", help="folder for the whole result, as Parquet")
        sub.add_argument("--rows", type=int, default=20, help="rows to show without --output")
        return sub

    command(publish, "tables", "output")
    stream(enrich, "output")
    sub = stream(ingest, "table")
    sub.add_argument("--dimension-default", help="what a null dimension is stored as")
    sub.add_argument("--max-records-per-file", type=int)
    sub.add_argument("--row-group-bytes", type=int, help="small row groups let filters skip more")
    sub.add_argument("--repeats-within", help="messages repeated within this time, such as '1 hour', count once")
    sub.add_argument("--flush-rows", type=int, help="topics of files: write once so many messages wait")
    sub.add_argument("--flush-seconds", type=float, default=3600.0, help="or one has waited for so long")
    sub.add_argument("--name", help="a name in the catalog that new batches are made known under")
    sub.add_argument("--rebalance", action="store_true", help="for messages that are not in time order")
    sub = stream(live, "output")
    sub.add_argument("name", choices=[*LIVE, *CHANGES])
    now = "what to take for now, in epoch milliseconds; the clock without it"
    sub = result(report, "table")
    sub.add_argument("name", choices=[*REPORTS, "all"])
    sub.add_argument("--as-of-ms", type=int, help=now)
    result(sql, "table").add_argument("text")
    command(register, "table").add_argument("--name", default="food_orders")
    command(compact, "table").add_argument("--least", type=int, default=2, help="batches of a date worth merging")
    sub = command(expire, "table")
    sub.add_argument("--as-of-ms", type=int, help=now)
    sub.add_argument("--days", type=int, default=1)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run a command; a session that is made here is stopped here."""
    args = parser().parse_args(argv)
    session = spark or build_session()
    try:
        args.run(session, args)
    except KeyboardInterrupt:
        pass
    finally:
        if spark is None:
            session.stop()
