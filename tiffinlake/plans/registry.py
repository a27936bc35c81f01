"""The registered queries: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.functions import order_columns
from tiffinlake.operators import table
from tiffinlake.operators.codec import decode, encode
from tiffinlake.operators.enrich import enrich, raw_columns
from tiffinlake.plans import reports
from tiffinlake.plans.sql import run_sql
from tiffinlake.session import exists, remove, scratch_dir
from tiffinlake.sources import files
from tiffinlake.sources import orders as src
from tiffinlake.streaming import changes, jobs, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def food_orders(spark: SparkSession, folder: str, columns: Collection[str] = schema.TABLE_COLUMNS) -> DataFrame:
    """Enriched orders, with all the columns of the table or some of them."""
    return enrich(src.raw_orders(spark, folder, raw_columns(columns)), only=columns).select(*columns)


# --- the ten reports ---------------------------------------------------------


_tables: dict[tuple[str, str], str] = {}


def write_stored(spark: SparkSession, folder: str) -> str:
    """The enriched orders as a table: conformed, by date, sorted.

    Events come in time order, but joining customers that are too many to
    broadcast scatters them: so the dates are gathered again.
    """
    path = scratch_dir(spark, "table")
    table.write_table(table.fill_defaults(food_orders(spark, folder)), path, 0, "derived", rebalance=True)
    return path


def stored_path(spark: SparkSession, folder: str) -> str:
    """Written once per application and folder of tables, and again if it has gone."""
    key = spark.sparkContext.applicationId, folder
    if key not in _tables or not exists(spark, _tables[key]):
        _tables[key] = write_stored(spark, folder)
    return _tables[key]


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return table.read_table(spark, stored_path(spark, folder))


def newest_ms(spark: SparkSession, folder: str) -> int:
    """The time of the last event: what a report on given tables takes for now."""
    return src.read(spark, folder, "events").agg(F.max(F.unix_millis("ts"))).first()[0] or 0


def _report(spark: SparkSession, folder: str, report: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    return report(stored(spark, folder), **options)


@register
def q1_totals(spark, folder):
    return _report(spark, folder, reports.totals)


@register
def q2_city_revenue(spark, folder):
    return _report(spark, folder, reports.city_revenue)


@register
def q3_cuisine_popularity(spark, folder):
    return _report(spark, folder, reports.cuisine_popularity)


@register
def q4_status_share(spark, folder):
    return _report(spark, folder, reports.status_share)


@register
def q5_payment_mix(spark, folder):
    return _report(spark, folder, reports.payment_mix)


@register
def q6_peak_offpeak(spark, folder):
    return _report(spark, folder, reports.peak_comparison)


@register
def q7_top_restaurants(spark, folder):
    return _report(spark, folder, reports.top_restaurants)


@register
def q8_value_category(spark, folder):
    return _report(spark, folder, reports.value_categories)


@register
def q9_hourly_volume(spark, folder):
    return _report(spark, folder, reports.hourly_volume)


@register
def q9_last_24h(spark, folder):
    return _report(spark, folder, reports.hourly_volume_last_day, as_of_ms=newest_ms(spark, folder))


@register
def q10_high_value_orders(spark, folder):
    return _report(spark, folder, reports.high_value_orders)


@register
def running_totals_by_order(spark, folder):
    """The number of orders and their revenue as each order comes."""
    return reports.running_totals_by_order(stored(spark, folder))


# A name of their own: the caller may have a view food_orders.
VIEW = "tiffinlake_registered_orders"

# The total in the window is over at most a group per nation and status.
ADHOC = """
    SELECT city, status, COUNT(*) AS orders,
           ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct,
           ROUND(AVG(price_per_item), 2) AS avg_item_price
    FROM food_orders
    WHERE is_peak_hour = 1 OR is_first_order = 1
    GROUP BY city, status
    HAVING COUNT(*) > 1
"""


@register
def adhoc_sql(spark, folder):
    return run_sql(spark, ADHOC.replace("food_orders", VIEW), stored(spark, folder), VIEW)


# --- computed columns --------------------------------------------------------


@register
def enrich_hour(spark, folder):
    return food_orders(spark, folder, ["order_id", "hour_of_day"])


@register
def enrich_peak(spark, folder):
    return food_orders(spark, folder, ["order_id", "is_peak_hour"])


@register
def enrich_local_hours(spark, folder):
    """The hour, and with it the peak, where the orders are placed and not in UTC."""
    orders = src.raw_orders(spark, folder, ["order_id", "timestamp"])
    local = enrich(orders, tz="Asia/Kolkata", only=["hour_of_day", "is_peak_hour"])
    return local.select("order_id", "hour_of_day", "is_peak_hour")


@register
def enrich_value_category(spark, folder):
    return food_orders(spark, folder, ["order_id", "order_value_category"])


@register
def enrich_price_per_item(spark, folder):
    return food_orders(spark, folder, ["order_id", "price_per_item"])


@register
def enrich_high_value(spark, folder):
    return food_orders(spark, folder, ["order_id", "is_high_value"])


@register
def enrich_flags(spark, folder):
    return food_orders(spark, folder, ["order_id", "discount_applied", "is_first_order"])


@register
def enrich_full(spark, folder):
    return food_orders(spark, folder)


@register
def status_label(spark, folder):
    label = order_columns.status_label(F.col("status"))
    return src.raw_orders(spark, folder, ["order_id", "status"]).withColumn("label", label)


# --- derivation of order columns ---------------------------------------------


@register
def derive_orders(spark, folder):
    return src.raw_orders(spark, folder)


@register
def derive_items(spark, folder):
    """The words of each part's name as the list that an order gives of its dishes."""
    return src.read(spark, folder, "part").select("p_partkey", order_columns.joined_words(F.col("p_name")).alias("items"))


# --- messages ----------------------------------------------------------------

_topics: dict[tuple[str, str, str], str] = {}


def _publish(spark: SparkSession, folder: str, name: str, messages: DataFrame) -> str:
    """Publish messages to a new topic, for later queries to find."""
    path = scratch_dir(spark, name)
    files.publish(messages, path)
    _topics[spark.sparkContext.applicationId, folder, name] = path
    return path


def _published(spark: SparkSession, folder: str, name: str) -> str | None:
    """Where a topic was published, unless it has gone."""
    path = _topics.get((spark.sparkContext.applicationId, folder, name))
    return path if path and exists(spark, path) else None


def publish_orders(spark: SparkSession, folder: str) -> str:
    """All orders as messages; null fields are written, as a producer would."""
    return _publish(spark, folder, "raw", encode(src.raw_orders(spark, folder), keep_nulls=True))


def raw_topic(spark: SparkSession, folder: str) -> str:
    """Published once per application and folder of tables."""
    return _published(spark, folder, "raw") or publish_orders(spark, folder)


def damaged(value: Column, event_id: Column) -> Column:
    """The message text with one of ten kinds of damage, by event."""
    kinds = (
        F.lit("not json"),
        F.lit(""),
        F.lit(None).cast("string"),
        F.lit("[1,2]"),
        F.regexp_replace(value, '"quantity":[0-9]+', '"quantity":2.5'),
        F.regexp_replace(value, '"price":[0-9.E]+', '"price":"x"'),
        F.regexp_replace(value, '"quantity":([0-9]+)', '"quantity":"$1"'),
        F.regexp_replace(value, '"discount_applied":(true|false)', '"discount_applied":"$1"'),
        F.regexp_replace(value, '"timestamp":([0-9]+)', '"timestamp":"$1"'),
        F.regexp_replace(value, '"items"', '"dishes"'),
    )
    case = F
    for kind, text in enumerate(kinds[:-1]):
        case = case.when(F.pmod(event_id, F.lit(len(kinds))) == kind, text)
    return case.otherwise(kinds[-1])


def damaged_topic(spark: SparkSession, folder: str) -> str:
    """All orders as messages, those of cancelled orders damaged."""
    published = _published(spark, folder, "damaged")
    if published:
        return published
    event_id = F.substring("order_id", 5, 20).cast("bigint")
    text = F.to_json(F.struct("*"))
    value = F.when(F.col("status") == src.OTHER_STATUS, damaged(text, event_id)).otherwise(text)
    messages = src.raw_orders(spark, folder).select(
        F.col("order_id").cast("binary").alias("key"), value.cast("binary").alias("value")
    )
    return _publish(spark, folder, "damaged", messages)


def _with_key(messages: DataFrame, ddl: str) -> DataFrame:
    """Key and content of messages."""
    content = F.from_json(F.col("value").cast("string"), ddl)
    return messages.select(F.col("key").cast("string").alias("key"), content.alias("m")).select("key", "m.*")


@register
def publish_batch(spark, folder):
    """Publish all orders and read the messages back."""
    return _with_key(files.read_topic(spark, publish_orders(spark, folder)), schema.RAW_ORDER)


@register
def decode_orders(spark, folder):
    return decode(files.read_topic(spark, raw_topic(spark, folder)))


@register
def decode_malformed(spark, folder):
    return enrich(decode(files.read_topic(spark, damaged_topic(spark, folder))))


@register
def encode_envelope(spark, folder):
    """Enriched messages, read back."""
    path = scratch_dir(spark, "envelope")
    files.publish(encode(food_orders(spark, folder)), path)
    return _with_key(files.read_topic(spark, path), schema.FOOD_ORDERS)


# --- the table ---------------------------------------------------------------


@register
def conform_defaults(spark, folder):
    """Damaged messages, enriched, encoded and stored with defaults for nulls."""
    path = scratch_dir(spark, "damaged-enriched")
    files.publish(jobs.enriched_messages(files.read_topic(spark, damaged_topic(spark, folder))), path)
    return table.conform(files.read_topic(spark, path))


@register
def retention_1d(spark, folder):
    return table.retain(stored(spark, folder), newest_ms(spark, folder)).drop(schema.DATE_COLUMN)


@register
def table_scan(spark, folder):
    """The table, filtered by its indexed columns in SQL."""
    text = f"SELECT * FROM {VIEW} WHERE status = 'delivered' AND order_value_category <> 'Budget'"
    return run_sql(spark, text, stored(spark, folder), VIEW)


@register
def table_index_scan(spark, folder):
    """The table, filtered by two indexed columns that it is not sorted by first."""
    city = src.read(spark, folder, "nation").agg(F.max("n_name")).first()[0]
    rows = stored(spark, folder).where((F.col("payment_method") == "Debit Card") & (F.col("city") == city))
    return rows.select("order_id", "city", "payment_method", "cuisine", "price", "status")


@register
def table_expire(spark, folder):
    """Write the table once more and delete the days before the retention period."""
    path = scratch_dir(spark, "table")
    table.write_table(stored(spark, folder).drop(schema.DATE_COLUMN), path, 0, "copied", rebalance=True)
    table.drop_expired(spark, path, newest_ms(spark, folder))
    return table.read_table(spark, path)


@register
def table_compact(spark, folder):
    """A table in many small batches, merged: the same rows."""
    path = scratch_dir(spark, "table")
    rows = stored(spark, folder).drop(schema.DATE_COLUMN)
    for batch in range(4):
        part = rows.where(F.pmod(F.xxhash64("order_id"), F.lit(4)) == batch)
        table.write_table(part, path, batch, "parts", rebalance=True)
    table.compact(spark, path)
    return _table_rows(spark, path)


@register
def catalog_table(spark, folder):
    """The table by its name in the catalog; its second batch is made known by who wrote it."""
    path = scratch_dir(spark, "table")
    rows = stored(spark, folder).drop(schema.DATE_COLUMN)
    name = f"food_orders_{zlib.crc32(path.encode()):08x}"
    later = F.col("is_first_order") == 1
    table.write_table(rows.where(~later), path, 0, "known", rebalance=True)
    table.create_table(spark, path, name)
    table.write_table(rows.where(later), path, 1, "known", rebalance=True)
    table.add_batch(spark, path, name, 1, "known")
    counts = spark.table(name).groupBy(schema.DATE_COLUMN, "status")
    return counts.agg(F.count(F.lit(1)).alias("orders"), F.sum("is_high_value").alias("high_value"))


# --- streams -----------------------------------------------------------------

def _stream(spark: SparkSession, topic: str) -> DataFrame:
    return files.stream_topic(spark, topic, max_bytes_per_trigger=files.BATCH_BYTES)


def enrich_topic(spark: SparkSession, raw: str, processed: str, checkpoint: str, **options) -> None:
    """Stream what the raw topic holds and the checkpoint has not seen."""
    query = jobs.start_enrichment(
        _stream(spark, raw),
        lambda messages: files.stream_writer(messages, processed),
        checkpoint,
        available_now=True,
        **options,
    )
    jobs.run_to_end(query)


def ingest_topic(spark: SparkSession, processed: str, path: str, checkpoint: str, **options) -> None:
    """Stream what the processed topic holds into the table, in whatever order it comes."""
    query = jobs.start_ingestion(
        _stream(spark, processed), path, checkpoint, rebalance=True, available_now=True, **options
    )
    jobs.run_to_end(query)


def _table_rows(spark: SparkSession, path: str) -> DataFrame:
    return table.read_table(spark, path).drop(schema.DATE_COLUMN)


@register
def stream_enrich_append(spark, folder):
    work = scratch_dir(spark, "enrich-stream")
    enrich_topic(spark, raw_topic(spark, folder), f"{work}/processed", f"{work}/checkpoint")
    return decode(files.read_topic(spark, f"{work}/processed"), schema.FOOD_ORDERS)


@register
def stream_ingest_table(spark, folder):
    """Both hops, with the thresholds of a flush."""
    work = scratch_dir(spark, "ingest-stream")
    enrich_topic(spark, raw_topic(spark, folder), f"{work}/processed", f"{work}/checkpoint-1")
    ingest_topic(spark, f"{work}/processed", f"{work}/table", f"{work}/checkpoint-2", max_records_per_file=1_000_000)
    remove(spark, f"{work}/processed")
    return _table_rows(spark, f"{work}/table")


@register
def ingest_two_topics(spark, folder):
    """Two topics, each with a stream and a checkpoint of its own, into one table."""
    work = scratch_dir(spark, "two-streams")
    raw = files.read_topic(spark, raw_topic(spark, folder))
    peak = F.coalesce(F.get_json_object(F.col("value").cast("string"), "$.payment_method") == "UPI", F.lit(False))
    for number, part in enumerate((raw.where(peak), raw.where(~peak))):
        files.publish(jobs.enriched_messages(part), f"{work}/topic-{number}")
        ingest_topic(spark, f"{work}/topic-{number}", f"{work}/table", f"{work}/checkpoint-{number}")
        remove(spark, f"{work}/topic-{number}")
    return _table_rows(spark, f"{work}/table")


@register
def ingest_repeated_topic(spark, folder):
    """A topic that has a tenth of its messages twice, as a producer leaves it that was not answered; they count once."""
    work = scratch_dir(spark, "repeated")
    raw = files.read_topic(spark, raw_topic(spark, folder))
    again = F.pmod(F.xxhash64("key"), F.lit(10)) == 0
    files.publish(jobs.enriched_messages(raw), f"{work}/topic")
    files.publish(jobs.enriched_messages(raw.where(again)), f"{work}/topic")
    ingest_topic(jobs.live_session(spark), f"{work}/topic", f"{work}/table", f"{work}/checkpoint", repeats_within="1 hour")
    remove(spark, f"{work}/topic")
    remove(spark, f"{work}/checkpoint")
    return _table_rows(spark, f"{work}/table")


@register
def stream_progress(spark, folder):
    """What both hops reported of their batches, added up."""
    work = scratch_dir(spark, "progress")
    with progress.ProgressLog(spark, f"{work}/log") as log:
        for hop, run in (
            ("enrichment", lambda **named: enrich_topic(spark, raw_topic(spark, folder), f"{work}/processed", f"{work}/checkpoint-1", **named)),
            ("ingestion", lambda **named: ingest_topic(spark, f"{work}/processed", f"{work}/table", f"{work}/checkpoint-2", **named)),
        ):
            run(name=hop)
            log.wait_for_all()
    return progress.totals(progress.read_progress(spark, f"{work}/log")).select("name", "input_rows")


@register
def stream_restart(spark, folder):
    """Two runs on the same checkpoints; the second sees only what was added."""
    work = scratch_dir(spark, "restart-stream")
    raw = files.read_topic(spark, raw_topic(spark, folder))
    closed = F.get_json_object(F.col("value").cast("string"), "$.status").isin("delivered", "cancelled")
    for arriving in (raw.where(closed), raw.where(~F.coalesce(closed, F.lit(False)))):
        files.publish(arriving, f"{work}/raw")
        enrich_topic(spark, f"{work}/raw", f"{work}/processed", f"{work}/checkpoint-1")
        ingest_topic(spark, f"{work}/processed", f"{work}/table", f"{work}/checkpoint-2")
    return _table_rows(spark, f"{work}/table")


def _live(
    spark: SparkSession,
    folder: str,
    report: Callable[[DataFrame], DataFrame],
    finish: Callable[[DataFrame], DataFrame] = lambda result: result,
) -> DataFrame:
    work = scratch_dir(spark, "live")
    topic = raw_topic(spark, folder)
    orders = jobs.live_orders(_stream(jobs.live_session(spark), topic), reports.READS[report])
    result = report(orders)
    query = jobs.start_live(result, f"{work}/out", f"{work}/checkpoint", finish, available_now=True)
    jobs.run_to_end(query)
    remove(spark, f"{work}/checkpoint")
    return jobs.read_live(spark, f"{work}/out", finish(report(food_orders(spark, folder, reports.READS[report]))).schema)


def _changes(spark: SparkSession, folder: str, report: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """A report whose batches write the groups that they changed: the groups at the end."""
    work = scratch_dir(spark, "live")
    orders = jobs.live_orders(_stream(jobs.live_session(spark), raw_topic(spark, folder)), reports.READS[report])
    result = report(orders)
    query = changes.start_changes(result, f"{work}/out", f"{work}/checkpoint", keys, available_now=True)
    jobs.run_to_end(query)
    remove(spark, f"{work}/checkpoint")
    return changes.read_changes(spark, f"{work}/out", result.schema, keys)


@register
def live_totals(spark, folder):
    return _live(spark, folder, reports.running_totals)


@register
def live_city_revenue(spark, folder):
    return _changes(spark, folder, reports.by_city, "city")


@register
def live_cuisine_orders(spark, folder):
    return _live(spark, folder, reports.cuisine_popularity)


@register
def live_peak_offpeak(spark, folder):
    return _live(spark, folder, reports.peak_comparison)


@register
def live_status_share(spark, folder):
    """Counts on the stream, their shares of the total in each batch's result."""
    return _live(spark, folder, reports.status_counts, reports.share_of_counts)


@register
def live_top_restaurants(spark, folder):
    return reports.top_by_revenue(_changes(spark, folder, reports.by_restaurant, "restaurant_name"))


@register
def live_last_24h(spark, folder):
    """Orders per hour of the day over the last day, to the minute, with the state of that day only."""
    work = scratch_dir(spark, "live")
    orders = jobs.live_orders(_stream(jobs.live_session(spark), raw_topic(spark, folder)), [schema.TIME_COLUMN])
    minutes = changes.orders_per_minute(orders)
    jobs.run_to_end(changes.start_changes(minutes, f"{work}/out", f"{work}/checkpoint", ["minute"], keep=changes.last_day, available_now=True))
    remove(spark, f"{work}/checkpoint")
    return reports.hours_of_minutes(changes.last_day(changes.read_changes(spark, f"{work}/out", minutes.schema, ["minute"])))
