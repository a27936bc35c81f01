"""Streams with state: repeats, changes by group, the last day; flushes and progress."""

import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.functions.order_columns import MS_PER_DAY
from tiffinlake.operators import table
from tiffinlake.operators.codec import decode, encode
from tiffinlake.plans import registry, reports
from tiffinlake.sources import files
from tiffinlake.sources import orders as src
from tiffinlake.streaming import changes, jobs, progress


@pytest.fixture(scope="module")
def raw(spark, small, tmp_path_factory):
    """All orders as messages, in five files."""
    path = str(tmp_path_factory.mktemp("raw") / "topic")
    files.publish(encode(src.raw_orders(spark, small).repartition(5, "order_id"), keep_nulls=True), path)
    return path


@pytest.fixture(scope="module")
def orders(spark, small):
    return registry.food_orders(spark, small).cache()


@pytest.fixture
def live(spark):
    return jobs.live_session(spark, 2)


def ends(query):
    return jobs.run_to_end(query)


def test_state_is_kept_by_rocksdb_in_small_parts(spark, live):
    assert "RocksDB" in live.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert live.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != live.conf.get("spark.sql.streaming.stateStore.providerClass")


def by_city(live, topic, path, checkpoint, **options):
    messages = files.stream_topic(live, topic, max_files_per_trigger=1)
    report = reports.by_city(jobs.live_orders(messages, reports.READS[reports.by_city]))
    return report, ends(changes.start_changes(report, path, checkpoint, ["city"], available_now=True, **options))


def test_changes_add_up_to_the_batch_report(spark, live, raw, orders, tmp_path):
    report, query = by_city(live, raw, f"{tmp_path}/out", f"{tmp_path}/c")
    assert len({p.batchId for p in query.recentProgress if p.numInputRows}) == 5
    got = changes.read_changes(spark, f"{tmp_path}/out", report.schema, ["city"])
    assert sorted(got.collect()) == sorted(reports.by_city(orders).collect())


def test_a_batch_writes_only_what_changed_and_a_restart_goes_on(spark, live, raw, orders, tmp_path):
    """Two runs on one checkpoint; the second brings one city and writes one row."""
    topic, one = f"{tmp_path}/raw", "NATION_2"
    part = lambda only: encode(decode(files.read_topic(spark, raw)).where((F.col("city") == one) == only))
    files.publish(part(False), topic)
    by_city(live, topic, f"{tmp_path}/out", f"{tmp_path}/c")
    before = set(glob.glob(f"{tmp_path}/out/*/*"))
    files.publish(part(True).coalesce(1), topic)
    report, _ = by_city(jobs.live_session(spark, 2), topic, f"{tmp_path}/out", f"{tmp_path}/c")
    added = set(glob.glob(f"{tmp_path}/out/*/*")) - before
    assert sum(spark.read.parquet(folder).count() for folder in added) == 1
    got = changes.read_changes(spark, f"{tmp_path}/out", report.schema, ["city"])
    assert sorted(got.collect()) == sorted(reports.by_city(orders).collect())


def test_a_new_checkpoint_starts_a_new_result(spark, live, raw, tmp_path):
    by_city(live, raw, f"{tmp_path}/out", f"{tmp_path}/c1")
    files.publish(encode(decode(files.read_topic(spark, raw)).where("city = 'NATION_2'")), f"{tmp_path}/few")
    report, _ = by_city(live, f"{tmp_path}/few", f"{tmp_path}/out", f"{tmp_path}/c2")
    got = changes.read_changes(spark, f"{tmp_path}/out", report.schema, ["city"])
    assert [r["city"] for r in got.collect()] == ["NATION_2"]


def test_the_log_is_folded_and_stays_whole(spark, live, raw, orders, tmp_path):
    topic = f"{tmp_path}/raw"
    files.publish(files.read_topic(spark, raw).repartition(20), topic)
    report, _ = by_city(live, topic, f"{tmp_path}/out", f"{tmp_path}/c", fold_every=4)
    kinds = [os.path.basename(f).split("-")[0] for f in glob.glob(f"{tmp_path}/out/*/*")]
    assert kinds.count("batch") <= 8 and 1 <= kinds.count("fold") <= 2
    got = changes.read_changes(spark, f"{tmp_path}/out", report.schema, ["city"])
    assert sorted(got.collect()) == sorted(reports.by_city(orders).collect())


def test_a_batch_that_is_repeated_counts_once(spark, live, raw, orders, tmp_path, monkeypatch):
    """The changes are written and the driver lost before the batch could be ticked off."""
    from pyspark.errors import StreamingQueryException

    fold, calls = changes._fold, []

    def lost(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        fold(*args)

    monkeypatch.setattr(changes, "_fold", lost)
    with pytest.raises(StreamingQueryException):
        by_city(live, raw, f"{tmp_path}/out", f"{tmp_path}/c", fold_every=1)
    report, _ = by_city(live, raw, f"{tmp_path}/out", f"{tmp_path}/c", fold_every=1)
    got = changes.read_changes(spark, f"{tmp_path}/out", report.schema, ["city"])
    assert sorted(got.collect()) == sorted(reports.by_city(orders).collect())


# --- the last day ------------------------------------------------------------


def minutes_of(live, topic, path, checkpoint, now_ms=None):
    messages = files.stream_topic(live, topic, max_files_per_trigger=1)
    counts = changes.orders_per_minute(jobs.live_orders(messages, ["timestamp"]), now_ms)
    query = ends(changes.start_changes(counts, path, checkpoint, ["minute"], keep=changes.last_day, fold_every=3, available_now=True))
    return counts.schema, query


def times_topic(spark, times_per_file, topic):
    """A file of messages for each list of times; they are read in the order in which they were written."""
    for number, times in enumerate(times_per_file):
        rows = spark.createDataFrame([(f"o{number}-{i}", t) for i, t in enumerate(times)], "order_id STRING, `timestamp` BIGINT").coalesce(1)
        files.publish(rows.select(F.col("order_id").cast("binary").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value")), topic)
        time.sleep(0.02)


def expected_hours(times, now_ms):
    kept = [t for t in times if t is not None and t <= now_ms]
    first = max(kept) // 60_000 * 60_000 - MS_PER_DAY
    hours = {}
    for t in kept:
        if t // 60_000 * 60_000 > first:
            hour = t // 3_600_000 % 24
            hours[hour] = hours.get(hour, 0) + 1
    return hours


def test_the_last_day_equals_the_batch_report_and_its_state_stays_small(spark, live, tmp_path):
    """Six days of orders in order of time, an order a few minutes, each file half a day."""
    start = 1_704_067_200_000
    files_ = [[start + f * MS_PER_DAY // 2 + i * 173_000 for i in range(249)] for f in range(12)]
    # Late by hours, late by days, without a time, and dated in the future.
    files_[6] += [start + 3 * MS_PER_DAY - 5 * 3_600_000, start + 1000, None, 253_370_764_800_000]
    times_topic(spark, files_, f"{tmp_path}/raw")
    now = start + 7 * MS_PER_DAY
    columns, query = minutes_of(live, f"{tmp_path}/raw", f"{tmp_path}/out", f"{tmp_path}/c", now)
    state = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert len(state) >= 12 and max(state) <= 3.2 * 249 and state[-1] <= state[5]
    got = reports.hours_of_minutes(changes.last_day(changes.read_changes(spark, f"{tmp_path}/out", columns, ["minute"])))
    times = [t for f in files_ for t in f]
    assert {r["hour_of_day"]: r["orders"] for r in got.collect()} == expected_hours(times, now)
    # The batch report up to the end of the newest minute, less the one millisecond that it takes more.
    newest = max(t for t in times if t and t <= now) // 60_000 * 60_000 + 59_999
    rows = spark.createDataFrame([(t, t // 3_600_000 % 24) for t in times if t and t <= now and t > newest - MS_PER_DAY], "`timestamp` BIGINT, hour_of_day INT")
    assert sorted(got.collect()) == sorted(reports.hourly_volume_last_day(rows, newest).collect())


def test_the_last_day_of_given_orders(spark, live, raw, orders, tmp_path):
    columns, _ = minutes_of(live, raw, f"{tmp_path}/out", f"{tmp_path}/c")
    got = reports.hours_of_minutes(changes.last_day(changes.read_changes(spark, f"{tmp_path}/out", columns, ["minute"])))
    times = [r["timestamp"] for r in orders.select("timestamp").collect()]
    assert {r["hour_of_day"]: r["orders"] for r in got.collect()} == expected_hours(times, 2**60)


# --- repeats -----------------------------------------------------------------


def test_repeated_messages_count_once_within_and_across_batches(spark, live, raw, orders, tmp_path):
    topic = f"{tmp_path}/topic"
    messages = jobs.enriched_messages(files.read_topic(spark, raw))
    files.publish(messages.unionByName(messages.limit(200)).coalesce(1), topic)
    files.publish(messages.limit(300), topic)
    odd = spark.createDataFrame([(None, bytearray(b"not json")), (bytearray(b"k"), bytearray(b"not json")), (None, None), (bytearray(b"k"), None)], schema.MESSAGE)
    files.publish(odd.unionByName(odd), topic)

    def run(session):
        ends(jobs.start_ingestion(
            files.stream_topic(session, topic, max_files_per_trigger=1), f"{tmp_path}/table", f"{tmp_path}/c",
            rebalance=True, repeats_within="1 hour", available_now=True,
        ))
        return table.read_table(spark, f"{tmp_path}/table")

    stored = run(live)
    assert stored.where("order_id is not null").count() == 1000
    # Unreadable ones: one without a key by its value, one without either, one by its key.
    assert stored.where("order_id is null").count() == 3
    files.publish(messages.limit(50), topic)
    assert run(jobs.live_session(spark, 2)).count() == 1003
    assert orders.select("order_id").exceptAll(stored.select("order_id")).count() == 0


def test_without_the_option_nothing_is_dropped(spark, raw, tmp_path):
    messages = jobs.enriched_messages(files.read_topic(spark, raw))
    files.publish(messages.unionByName(messages.where("key is not null")), f"{tmp_path}/topic")
    registry.ingest_topic(spark, f"{tmp_path}/topic", f"{tmp_path}/table", f"{tmp_path}/c")
    assert table.read_table(spark, f"{tmp_path}/table").count() == 2000


# --- flushes, starting at a time, registration, progress ---------------------


def test_few_messages_wait_and_many_do_not(spark, raw, tmp_path):
    """100 rows or a time, whichever comes first; waiting goes on after a restart."""
    topic, mark = f"{tmp_path}/topic", f"{tmp_path}/c/flushed"
    messages = jobs.enriched_messages(files.read_topic(spark, raw)).cache()
    seen = []

    def begin():
        seen.append(files.read_topic(spark, topic).count())
        return jobs.start_ingestion(files.stream_topic(spark, topic), f"{tmp_path}/table", f"{tmp_path}/c", available_now=True)

    def flush(polls, rows=100, after_s=3600.0):
        left = [polls]

        def ended():
            left[0] -= 1
            return left[0] < 0

        return jobs.flush_when(lambda since: files.arrived_since(spark, topic, since), begin, mark, rows, after_s, 0.01, ended, spark)

    assert flush(3) == 0
    files.publish(messages.limit(60).coalesce(1), topic)
    assert flush(3) == 0 and not os.path.exists(f"{tmp_path}/table")
    files.publish(messages.limit(60).coalesce(1), topic)
    assert flush(3) == 1 and seen == [120]
    time.sleep(0.05)
    files.publish(messages.limit(20).coalesce(1), topic)
    assert flush(3) == 0
    assert table.read_table(spark, f"{tmp_path}/table").count() == 120
    time.sleep(0.6)
    assert flush(3, after_s=0.5) == 1
    assert table.read_table(spark, f"{tmp_path}/table").count() == 140


def test_a_stream_from_a_time_on(spark, raw, tmp_path):
    """Files of the last hour are replayed, older ones are not."""
    topic = f"{tmp_path}/topic"
    messages = files.read_topic(spark, raw)
    files.publish(messages.limit(70).coalesce(1), topic)
    (old,) = glob.glob(f"{topic}/*.parquet")
    files.publish(messages.limit(30).coalesce(1), topic)
    now = time.time()
    os.utime(old, (now - 7200, now - 7200))
    recent = files.stream_topic(spark, topic, starting_ms=int((now - 3600) * 1000))
    assert recent.columns == ["key", "value"]
    ends(jobs.start_enrichment(recent, lambda m: files.stream_writer(m, f"{tmp_path}/out"), f"{tmp_path}/c", available_now=True))
    assert files.read_topic(spark, f"{tmp_path}/out").count() == 30
    assert files.arrived_since(spark, topic, int((now - 3600) * 1000))[0] == 30
    assert files.arrived_since(spark, topic, -1)[0] == 100
    # A topic that a stream writes has its files in a log.
    assert files.arrived_since(spark, f"{tmp_path}/out", int((now - 3600) * 1000))[0] == 30
    assert files.arrived_since(spark, f"{tmp_path}/none", 0) == (0, None)


def test_ingested_batches_are_known_by_name(spark, raw, tmp_path):
    topic, place = f"{tmp_path}/topic", f"{tmp_path}/table"
    files.publish(jobs.enriched_messages(files.read_topic(spark, raw)).repartition(2), topic)

    def run(name, most):
        messages = files.stream_topic(spark, topic, max_files_per_trigger=most)
        ends(jobs.start_ingestion(messages, place, f"{tmp_path}/c", rebalance=True, catalog_name=name, available_now=True))

    table.write_table(table.conform(files.read_topic(spark, topic)).limit(0), place, 0, "none")
    os.makedirs(place, exist_ok=True)
    table.create_table(spark, place, "ingested_orders")
    run("ingested_orders", 1)
    assert spark.table("ingested_orders").count() == 1000
    spark.sql("DROP TABLE ingested_orders")


def test_progress_is_kept_as_a_table(spark, live, raw, tmp_path):
    with progress.ProgressLog(spark, f"{tmp_path}/log", rows=2) as log:
        messages = files.stream_topic(spark, raw, max_files_per_trigger=1)
        query = ends(jobs.start_enrichment(messages, lambda m: files.stream_writer(m, f"{tmp_path}/out"), f"{tmp_path}/c", available_now=True, name="hop"))
        log.wait_for_all()
        rows = progress.read_progress(spark, f"{tmp_path}/log")
        assert sorted(r.input_rows for r in rows.collect()) == sorted(p.numInputRows for p in query.recentProgress if p.numInputRows)
    total = progress.totals(rows).first()
    assert (total["name"], total["batches"], total["input_rows"], total["behind"]) == ("hop", 5, 1000, None)
    assert all(r.trigger_ms > 0 and r.query_id == str(query.id) and r.state_rows is None for r in rows.collect())


def test_lag_and_state_are_read_from_what_a_query_says():
    class Told:
        json = """{"id": "q", "runId": "r", "name": null, "batchId": 3, "timestamp": "2024-01-01T00:00:00.000Z", "numInputRows": 7,
            "inputRowsPerSecond": "NaN", "processedRowsPerSecond": 2.5, "durationMs": {"addBatch": 5, "triggerExecution": 9},
            "sources": [{"metrics": {"maxOffsetsBehindLatest": "12"}}, {"metrics": null}],
            "stateOperators": [{"numRowsTotal": 4, "memoryUsedBytes": 10, "numRowsDroppedByWatermark": 1}]}"""

    row = dict(zip(schema.column_names(progress.SCHEMA), progress.row_of(Told), strict=True))
    assert (row["behind"], row["state_rows"], row["late_rows"], row["batch_ms"], row["trigger_ms"]) == (12, 4, 1, 5, 9)
    assert row["input_rows_per_second"] is None and row["processed_rows_per_second"] == 2.5


def test_a_log_that_hears_nothing_says_so(spark, tmp_path):
    log = progress.ProgressLog(spark, f"{tmp_path}/log")
    log._begun.add("never")
    with pytest.raises(TimeoutError):
        log.wait_for_all(seconds=0.1)
    log.write()
    assert threading.active_count() and not os.path.exists(f"{tmp_path}/log")


def test_commands(spark, raw, orders, tmp_path):
    from tiffinlake import cli

    place = str(tmp_path)

    def live_rows(name, schema_, key):
        cli.main(["live", name, "--input", raw, "--output", f"{place}/{name}", "--checkpoint", f"{place}/c-{name}", "--once", "--state-partitions", "2"], spark)
        return changes.read_changes(spark, f"{place}/{name}", schema_, [key])

    cities = live_rows("all-cities", "city STRING, orders BIGINT, revenue DOUBLE, avg_order_value DOUBLE", "city")
    assert sorted(cities.collect()) == sorted(reports.by_city(orders).collect())
    minutes = changes.last_day(live_rows("minutes-last-day", "minute BIGINT, orders BIGINT", "minute"))
    times = [r["timestamp"] for r in orders.select("timestamp").collect()]
    assert minutes.agg(F.sum("orders")).first()[0] == sum(expected_hours(times, 2**60).values())
    files.publish(jobs.enriched_messages(files.read_topic(spark, raw)), f"{place}/processed")
    files.publish(jobs.enriched_messages(files.read_topic(spark, raw)), f"{place}/processed")
    os.makedirs(f"{place}/table")
    cli.main(["ingest", "--input", f"{place}/processed", "--table", f"{place}/table", "--checkpoint", f"{place}/c", "--once", "--rebalance",
              "--repeats-within", "1 hour", "--state-partitions", "2", "--name", "command_orders", "--progress", f"{place}/log"], spark)
    assert spark.table("command_orders").count() == 1000
    assert progress.read_progress(spark, f"{place}/log").agg(F.sum("input_rows")).first()[0] == 2000
    spark.sql("DROP TABLE command_orders")
