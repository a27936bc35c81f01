"""The stored table: layout, retention, registration, SQL."""

import datetime
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import tiffinlake_oracles as oracles
from tiffinlake import schema, session
from tiffinlake.functions.order_columns import MS_PER_DAY
from tiffinlake.functions import picks
from tiffinlake.operators import table
from tiffinlake.plans import registry, reports
from tiffinlake.plans.sql import run_sql


@pytest.fixture(scope="module")
def orders(spark, small):
    return table.fill_defaults(registry.food_orders(spark, small))


@pytest.fixture(scope="module")
def path(orders, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("table") / "food_orders")
    table.write_table(orders.repartition(8), place, 0, "w", rebalance=True)
    return place


@pytest.fixture(scope="module")
def stored(spark, path):
    return table.read_table(spark, path)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_round_trip(orders, stored):
    assert stored.columns == [*schema.TABLE_COLUMNS, "order_date"]
    back = stored.drop("order_date")
    assert orders.exceptAll(back).count() == 0 and back.count() == orders.count()


def test_filters_reach_the_files(stored):
    plan = plan_of(
        stored.where("status = 'delivered' and is_high_value = 1 and order_date = date'2024-01-05'").select("price")
    )
    assert "EqualTo(status,delivered)" in plan and "EqualTo(is_high_value,1)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*order_date#\d+ = 2024-01-05", plan)
    assert "ReadSchema: struct<price:float,status:string,is_high_value:int>" in plan


def test_one_file_per_small_date(path):
    dates = glob.glob(f"{path}/order_date=*")
    assert len(dates) == 30
    assert all(len(glob.glob(f"{date}/writer=w/batch=0/*.parquet")) == 1 for date in dates)


def test_a_date_with_most_rows_is_split(spark, settings, tmp_path):
    """A third of all rows on one date go to several tasks and files."""
    settings({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"})
    day = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 30)
    rows = spark.range(0, 300_000, numPartitions=8).select(
        F.col("id").cast("string").alias("order_id"), (day * MS_PER_DAY).alias("timestamp"), F.lit("x").alias("city")
    )
    table.write_table(rows, str(tmp_path / "t"), 0, "w", rebalance=True)
    hot, every = (len(glob.glob(f"{tmp_path}/t/order_date={d}/*/*/*.parquet")) for d in ("1970-01-01", "*"))
    assert hot >= 3
    assert every < 30 * 8 / 2  # a plain write would have each of 8 tasks write each of 30 dates
    assert spark.read.parquet(str(tmp_path / "t")).select(F.countDistinct("order_id")).first()[0] == 300_000


def test_rows_per_file(orders, spark, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders, place, 0, "w", max_records_per_file=10)
    counts = spark.read.parquet(place).groupBy(F.input_file_name()).count()
    assert counts.agg(F.max("count")).first()[0] == 10
    assert table.read_table(spark, place).where("city = 'NATION_2'").count() == orders.where("city = 'NATION_2'").count()


def test_undated_rows_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", 2**62), ("c", 0)], "order_id STRING, `timestamp` BIGINT")
    table.write_table(rows, str(tmp_path / "t"), 0, "w")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["order_id"], r["order_date"]) for r in back.collect()} == {
        ("a", None), ("b", None), ("c", datetime.date(1970, 1, 1)),
    }
    kept = table.retain(table.with_date(rows), MS_PER_DAY)
    assert {r["order_id"] for r in kept.collect()} == {"b", "c"}


def test_retention_is_inclusive_and_in_days(spark):
    rows = spark.createDataFrame([(t,) for t in (0, 1, MS_PER_DAY, None)], "`timestamp` BIGINT")
    assert [r[0] for r in table.retain(rows, MS_PER_DAY).collect()] == [0, 1, MS_PER_DAY]
    assert [r[0] for r in table.retain(rows, MS_PER_DAY + 1).collect()] == [1, MS_PER_DAY]
    assert table.retain(rows, 3 * MS_PER_DAY, days=3).count() == 3


def test_retention_skips_partitions(stored):
    newest = stored.agg(F.max("timestamp")).first()[0]
    assert newest == 1706657176220
    recent = table.retain(stored, newest)
    assert recent.count() == 41
    plan = plan_of(recent)
    assert "PartitionFilters: [(isnull(order_date" in plan and "GreaterThanOrEqual(timestamp," in plan


def test_a_batch_written_again_replaces_itself(spark, orders, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders.where("price < 600"), place, 0, "w")
    table.write_table(orders.where("price >= 600"), place, 1, "w")
    table.write_table(orders.where("price >= 600"), place, 1, "w")
    back = table.read_table(spark, place).drop("order_date")
    assert back.count() == 1000 and orders.exceptAll(back).count() == 0


def test_expired_days_are_dropped(spark, orders, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders, place, 0, "w")
    before = {os.path.basename(d)[-10:] for d in glob.glob(f"{place}/order_date=*")}
    dropped = table.drop_expired(spark, place, 1706657176220)
    left = {os.path.basename(d)[-10:] for d in glob.glob(f"{place}/order_date=*")}
    assert left == {"2024-01-29", "2024-01-30"}
    assert set(dropped) == before - left
    assert table.retain(table.read_table(spark, place), 1706657176220).count() == 41
    assert table.drop_expired(spark, place, 1706657176220) == []


def test_catalog_table(spark, orders, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders.where("price < 600"), place, 0, "w")
    assert table.create_table(spark, place, "stored_orders")
    assert spark.table("stored_orders").count() == orders.where("price < 600").count()
    table.write_table(orders.where("price >= 600"), place, 1, "w")
    assert not table.create_table(spark, place, "stored_orders")
    assert spark.table("stored_orders").count() == 1000
    assert spark.sql("SELECT COUNT(*) FROM stored_orders WHERE order_date = '2024-01-05'").first()[0] > 0
    spark.sql("DROP TABLE stored_orders")
    assert os.path.exists(place)


def test_a_taken_name_is_an_error(spark, path):
    spark.sql("CREATE TABLE taken (a INT, b INT) USING parquet PARTITIONED BY (b)")
    with pytest.raises(ValueError, match="taken"):
        table.create_table(spark, path, "taken")
    assert spark.table("taken").columns == ["a", "b"]
    spark.sql("DROP TABLE taken")


def test_a_quote_in_the_path(spark, orders, tmp_path):
    place = str(tmp_path / "o'clock")
    table.write_table(orders, place, 0, "w")
    assert table.create_table(spark, place, "quoted") and spark.table("quoted").count() == 1000
    spark.sql("DROP TABLE quoted")


def test_writers_do_not_replace_each_other(spark, orders, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders.where("price < 600"), place, 0, "one")
    table.write_table(orders.where("price >= 600"), place, 0, "two")
    assert table.read_table(spark, place).count() == 1000
    with pytest.raises(ValueError):
        table.write_table(orders, place, 0, "a/b")


def test_batches_are_merged_and_no_row_changes(spark, orders, tmp_path):
    place = str(tmp_path / "t")
    odd = orders.withColumn("timestamp", F.when(F.col("is_first_order") == 1, F.lit(None)).otherwise(F.col("timestamp")))
    for batch in range(5):
        table.write_table(odd.where(F.pmod(F.xxhash64("order_id"), F.lit(5)) == batch), place, batch, "w", rebalance=True)
    before = len(glob.glob(f"{place}/*/*/*/*.parquet"))
    merged = table.compact(spark, place)
    assert merged > 60 and len(glob.glob(f"{place}/*/*/*/*.parquet")) < before / 2
    back = table.read_table(spark, place).drop("order_date")
    assert back.count() == 1000 and odd.exceptAll(back).count() == 0
    # The stream may repeat its last batch, and a second run finds little to do.
    table.write_table(odd.where(F.pmod(F.xxhash64("order_id"), F.lit(5)) == 4), place, 4, "w", rebalance=True)
    assert table.compact(spark, place) == 0
    assert table.read_table(spark, place).count() == 1000
    assert not os.path.exists(f"{place}/_compact")


def in_four_batches(orders, place):
    for batch in range(4):
        table.write_table(orders.where(F.pmod(F.xxhash64("order_id"), F.lit(4)) == batch), place, batch, "w", rebalance=True)


def whole(spark, place, orders):
    back = table.read_table(spark, place).drop("order_date")
    return back.count() == 1000 and orders.exceptAll(back).count() == 0


def test_a_merge_that_died_is_completed(spark, orders, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    in_four_batches(orders, place)
    finish = table._finish

    def dies(spark, path, name):
        raise OSError("lost")

    monkeypatch.setattr(table, "_finish", dies)
    with pytest.raises(OSError):
        table.compact(spark, place)
    assert whole(spark, place, orders)
    monkeypatch.setattr(table, "_finish", finish)
    table.compact(spark, place)
    assert whole(spark, place, orders)
    assert glob.glob(f"{place}/_compact/*") == []


class Unwilling:
    """A file system whose renames or deletions fail from the n-th call on; it says False, as Hadoop's do."""

    def __init__(self, fs, call, allowed):
        self.fs, self.call, self.allowed = fs, call, allowed

    def __getattr__(self, name):
        real = getattr(self.fs, name)
        if name != self.call:
            return real

        def counted(*args):
            self.allowed[0] -= 1
            return real(*args) if self.allowed[0] >= 0 else False

        return counted


@pytest.mark.parametrize("call, allowed", [("rename", 0), ("rename", 3), ("rename", 33), ("delete", 0), ("delete", 5), ("delete", 90)])
def test_a_merge_whose_renames_or_deletions_fail_loses_nothing(spark, orders, tmp_path, monkeypatch, call, allowed):
    place = str(tmp_path / "t")
    in_four_batches(orders, place)
    real, left = session.file_system, [allowed]

    def unwilling(spark, path):
        fs, at = real(spark, path)
        return Unwilling(fs, call, left), at

    monkeypatch.setattr(session, "file_system", unwilling)
    with pytest.raises(OSError, match="could not"):
        table.compact(spark, place)
    monkeypatch.setattr(session, "file_system", real)
    table.compact(spark, place)
    assert whole(spark, place, orders)
    assert glob.glob(f"{place}/_compact/*") == glob.glob(f"{place}/*/.writer*") == []
    # One merged batch a date, and the last of the writer.
    assert all(len(glob.glob(f"{date}/writer=*")) <= 2 for date in glob.glob(f"{place}/order_date=*"))


def test_some_dates_are_merged_at_a_time(spark, orders, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    in_four_batches(orders, place)
    merges = []
    merge = table._merge

    def counted(spark, path, batches):
        merges.append({b[0] for b in batches})
        return merge(spark, path, batches)

    monkeypatch.setattr(table, "_merge", counted)
    monkeypatch.setattr(table, "DATES_AT_ONCE", 12)
    table.compact(spark, place)
    assert [len(dates) for dates in merges] == [12, 12, 6]
    assert whole(spark, place, orders)


def test_undated_batches_expire_by_when_they_were_written(spark, tmp_path):
    place = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", None)], "order_id STRING, `timestamp` BIGINT")
    table.write_table(rows, place, 0, "w")
    table.drop_expired(spark, place, 0)
    assert spark.read.parquet(place).count() == 1
    table.drop_expired(spark, place, 2**43)
    assert glob.glob(f"{place}/*/*/batch=*") == []


def test_the_status_prunes_row_groups(spark, tmp_path):
    """Row groups of one date whose range of status holds 'delivered': well under half."""
    import pyarrow.parquet as pq

    i = F.col("id")
    labels = ("placed", "preparing", "out_for_delivery", "delivered", "cancelled")
    status = F.element_at(F.array(*map(F.lit, labels)), (i % 5 + 1).cast("int"))
    rows = spark.range(0, 400_000, numPartitions=2).select(
        F.md5(i.cast("string")).alias("order_id"), F.lit(0).cast("bigint").alias("timestamp"),
        F.concat(F.lit("city"), i % 25).alias("city"), status.alias("status"),
    )
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 18))
    try:
        table.write_table(rows, str(tmp_path / "t"), 0, "w")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    groups = []
    for name in glob.glob(f"{tmp_path}/t/*/*/*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index("status")
        groups += [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    read = sum(s.min <= "delivered" <= s.max for s in groups)
    assert len(groups) >= 10 and read < 0.45 * len(groups)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """One date of many orders in small row groups; what stands in one indexed column says nothing about the others."""
    place, i = str(tmp_path_factory.mktemp("clustered") / "t"), F.col("id")
    pick = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n)).cast("int")
    label = lambda salt, *labels: F.element_at(F.array(*map(F.lit, labels)), pick(salt, len(labels)) + 1)
    rows = spark.range(0, 600_000, numPartitions=1).select(
        F.md5(i.cast("string")).alias("order_id"), F.lit(0).cast("bigint").alias("timestamp"),
        label(1, "placed", "preparing", "out_for_delivery", "delivered", "cancelled").alias("status"), F.concat(F.lit("city"), pick(2, 25)).alias("city"),
        F.concat(F.lit("cuisine"), pick(3, 7)).alias("cuisine"), label(4, *picks.PAYMENT_PERCENT).alias("payment_method"),
        label(5, "Budget", "Mid-Range", "Premium").alias("order_value_category"),
    )
    table.write_table(rows, place, 0, "w", row_group_bytes=1 << 18)
    return place


def row_groups(place, wanted):
    """How many row groups there are, and how many hold each of the wanted values: what a reader of dictionaries reads."""
    import pyarrow.parquet as pq

    every = read = 0
    for name in glob.glob(f"{place}/*/*/*/*.parquet"):
        file = pq.ParquetFile(name)
        for group in range(file.metadata.num_row_groups):
            columns = file.read_row_group(group, columns=list(wanted)).to_pydict()
            every += 1
            read += all(value in set(columns[c]) for c, value in wanted.items())
    return every, read


def scanned(rows):
    """Rows that the scan of files hands on; those of row groups that it skips are not among them."""
    plan = rows._jdf.queryExecution().executedPlan()
    assert rows.count() >= 0
    counted = rows.groupBy().count()
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    node = leaves.apply(0)
    while not node.metrics().contains("numOutputRows"):
        node = node.children().apply(0) if node.children().size() else node.plan()
        node = node.collectLeaves().apply(0)
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("wanted, share", [
    ({"city": "city3", "payment_method": "Debit Card"}, 0.35),
    ({"city": "city3"}, 0.6), ({"payment_method": "Debit Card"}, 0.7), ({"cuisine": "cuisine1"}, 0.7), ({"order_value_category": "Budget"}, 0.85),
    ({"status": "delivered", "city": "city3"}, 0.2), ({"cuisine": "cuisine1", "payment_method": "Debit Card", "city": "city9"}, 0.25),
])
def test_a_filter_on_indexed_columns_skips_row_groups(spark, clustered, wanted, share):
    every, read = row_groups(clustered, wanted)
    assert every >= 60 and 0 < read <= share * every
    rows = table.read_table(spark, clustered)
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    assert 0 < scanned(rows.select("order_id", *wanted)) <= 1.1 * share * 600_000
    expected = 600_000
    for column in wanted:
        expected /= {"status": 5, "city": 25, "cuisine": 7, "payment_method": 6, "order_value_category": 3}[column]
    assert rows.count() == pytest.approx(expected, rel=0.1)


def test_many_values_have_a_bloom_filter(spark, tmp_path):
    """Where a dictionary would be too large Parquet codes values plainly; an absent one is still seen to be absent."""
    import pyarrow.parquet as pq

    i = F.col("id")
    rows = spark.range(0, 300_000, numPartitions=1).select(
        i.cast("string").alias("order_id"), F.lit(0).cast("bigint").alias("timestamp"), F.lit("x").alias("status"),
        F.sha2(i.cast("string"), 256).alias("city"), F.lit("y").alias("cuisine"),
    )
    table.write_table(rows, str(tmp_path / "t"), 0, "w")
    (name,) = glob.glob(f"{tmp_path}/t/*/*/*/*.parquet")
    meta = pq.ParquetFile(name).metadata.row_group(0)
    coded = {meta.column(c).path_in_schema: meta.column(c).encodings for c in range(meta.num_columns)}
    assert "PLAIN" in coded["city"] and any("DICTIONARY" in e for e in coded["cuisine"])
    stored = table.read_table(spark, str(tmp_path / "t")).select("order_id", "city")
    first = stored.orderBy("city").first()["city"]
    absent = first[:-1] + ("0" if first[-1] != "0" else "1") + "5"
    assert scanned(stored.where(F.col("city") == absent)) == 0
    assert stored.where(F.col("city") == first).count() == 1


def test_rows_near_each_other_share_bits_of_each_column(spark):
    rows = spark.range(0, 4096).select(*[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(50)).alias(s) for s in "abc"])
    keyed = rows.select("*", table.cluster_key(["a", "b", "c"], bits=4).alias("key"))
    assert keyed.agg(F.max("key")).first()[0] < 1 << 12
    assert keyed.groupBy("a", "b", "c").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0] == 1
    # Rows that share the first bit of each column have about half of the values of each.
    near = keyed.groupBy(F.shiftright("key", 9)).agg(*[F.countDistinct(c).alias(c) for c in "abc"]).collect()
    assert len(near) == 8
    assert all(sum(r[c] for r in near) / 8 == 25 for c in "abc")


def test_a_batch_is_made_known_by_its_writer(spark, orders, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    odd = orders.withColumn("timestamp", F.when(F.col("is_first_order") == 1, F.lit(None)).otherwise(F.col("timestamp")))
    table.write_table(odd.where("price < 600"), place, 0, "w", rebalance=True)
    assert table.create_table(spark, place, "known_orders")
    assert spark.table("known_orders").count() == odd.where("price < 600").count()
    table.write_table(odd.where("price >= 600"), place, 1, "w", rebalance=True)
    table.write_table(odd.limit(3), place, 0, "other")
    listed = []
    monkeypatch.setattr(table, "_folders", lambda s, p, pattern, _real=table._folders: listed.append(pattern) or _real(s, p, pattern))
    table.add_batch(spark, place, "known_orders", 1, "w")
    assert {p for p in listed} == {"order_date=*", "writer=w/batch=1"}
    assert spark.table("known_orders").drop("order_date", "writer", "batch").exceptAll(odd).count() == 0
    assert spark.table("known_orders").count() == 1000
    assert spark.table("known_orders").where("order_date is null").count() == 100
    assert not table.create_table(spark, place, "known_orders")
    assert spark.table("known_orders").count() == 1003
    with pytest.raises(ValueError):
        table.add_batch(spark, str(tmp_path / "elsewhere"), "known_orders", 1, "w")
    spark.sql("DROP TABLE known_orders")


def test_running_totals_by_order_at_any_partitioning(spark, settings):
    """A moment that holds most orders, orders without a time, odd prices, one partition or many."""
    i = F.col("id")
    time_ms = F.when(i % 10 < 6, F.lit(5_000)).when(i % 10 == 6, F.lit(None)).otherwise(F.pmod(F.xxhash64(i), F.lit(9_000)))
    price = F.when(i % 50 == 0, F.lit(float("nan"))).when(i % 50 == 1, F.lit(None)).otherwise((i % 977) / 7)
    rows = spark.range(0, 20_000, numPartitions=7).select(
        F.format_string("o%06d", i).alias("order_id"), time_ms.cast("bigint").alias("timestamp"), price.cast("float").alias("price")
    )
    cents = {r.order_id: r.c for r in rows.select("order_id", F.coalesce(F.col("price").try_cast("decimal(18,2)"), F.lit(0)).alias("c")).collect()}
    ordered = sorted(((r.timestamp is not None, r.timestamp or 0, r.order_id) for r in rows.collect()))
    expected, total = {}, 0
    for n, (_, _, order) in enumerate(ordered, 1):
        total += cents[order]
        expected[order] = (n, float(total))
    for partitions in (1, 13):
        settings({"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"})
        totals = reports.running_totals_by_order(rows)
        assert {r.order_id: (r.total_orders, r.total_revenue) for r in totals.collect()} == expected
        plan = plan_of(totals)
        assert "SinglePartition" not in plan and "Python" not in plan
    assert reports.running_totals_by_order(rows.where("id < 0" if "id" in rows.columns else "order_id is null")).collect() == []


def test_one_order_of_the_future_moves_nothing(spark, orders, stored, tmp_path):
    place = str(tmp_path / "t")
    table.write_table(orders, place, 0, "w")
    future = orders.limit(1).withColumn("timestamp", F.lit(253_370_764_800_000)).withColumn("order_id", F.lit("late"))
    table.write_table(future, place, 1, "w")
    with_future = table.read_table(spark, place)
    as_of = 1706657176220
    assert reports.hourly_volume_last_day(with_future, as_of).collect() == reports.hourly_volume_last_day(stored, as_of).collect()
    table.drop_expired(spark, place, as_of)
    assert table.read_table(spark, place).where("order_date < '2025-01-01'").select("order_date").distinct().count() == 2


def test_revenue_is_exact_and_takes_odd_prices(spark):
    prices = [0.1] * 1000 + [float("nan"), float("inf"), 1e30, None]
    rows = spark.createDataFrame([(p,) for p in prices], "price FLOAT")
    row = reports.totals(rows).first()
    assert tuple(row) == (1004, 100.0)


REPORTS = {
    "q1_totals": reports.totals, "q2_city_revenue": reports.city_revenue,
    "q3_cuisine_popularity": reports.cuisine_popularity, "q4_status_share": reports.status_share,
    "q5_payment_mix": reports.payment_mix, "q6_peak_offpeak": reports.peak_comparison,
    "q7_top_restaurants": reports.top_restaurants, "q8_value_category": reports.value_categories,
    "q9_hourly_volume": reports.hourly_volume, "q10_high_value_orders": reports.high_value_orders,
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_over_the_table_equal_sql(spark, small, stored, name):
    """DataFrame over files = registered query = SQL over the view."""
    rows = sorted(map(tuple, REPORTS[name](stored).collect()), key=repr)
    assert rows == sorted(map(tuple, registry.QUERIES[name](spark, small).collect()), key=repr)
    by_sql = run_sql(spark, oracles.REPORTS[name], stored)
    assert by_sql.columns == REPORTS[name](stored).columns
    assert rows == sorted(map(tuple, by_sql.collect()), key=repr)


@pytest.mark.parametrize("report", reports.READS)
def test_reports_read_what_they_say(stored, report):
    options = {"as_of_ms": 0} if report is reports.hourly_volume_last_day else {}
    assert report(stored.select(*reports.READS[report]), **options).columns == report(stored, **options).columns


def test_share_as_a_window_in_sql(spark, stored):
    text = """SELECT status, COUNT(*) AS count,
                     ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct
              FROM food_orders GROUP BY status ORDER BY count DESC"""
    assert run_sql(spark, text, stored).collect() == reports.status_share(stored).collect()


def test_order_of_sorted_reports(stored):
    def column(report, name):
        return [row[name] for row in report(stored).collect()]

    assert column(reports.hourly_volume, "hour_of_day") == sorted(column(reports.hourly_volume, "hour_of_day"))
    for report, name in (
        (reports.city_revenue, "revenue"), (reports.cuisine_popularity, "orders"), (reports.status_share, "count"),
        (reports.payment_mix, "orders"), (reports.top_restaurants, "total_revenue"),
        (reports.value_categories, "avg_price"), (reports.high_value_orders, "price"),
    ):
        values = column(report, name)
        assert values == sorted(values, reverse=True)


def test_properties(stored):
    total = reports.totals(stored).first()
    grouped = (
        reports.by_city, reports.cuisine_popularity, reports.payment_mix, reports.peak_comparison,
        reports.value_categories, reports.hourly_volume,
    )
    for report in grouped:
        assert report(stored).agg(F.sum("orders")).first()[0] == total["total_orders"]
    assert reports.status_share(stored).agg(F.sum("pct")).first()[0] == pytest.approx(100, abs=0.05)
    assert reports.city_revenue(stored).count() == reports.TOP


def test_golden_values(spark, stored):
    assert tuple(reports.totals(stored).first()) == (1000, 940340.03)
    assert [tuple(r) for r in reports.city_revenue(stored, limit=3).collect()] == [
        ("NATION_2", 189, 182057.98, 963.27), ("NATION_17", 163, 151564.33, 929.84), ("NATION_10", 136, 127621.5, 938.39),
    ]
    assert {tuple(r) for r in reports.peak_comparison(stored).collect()} == {(0, 716, 927.12, 40.2), (1, 284, 973.67, 38.4)}
    assert [tuple(r) for r in reports.value_categories(stored).collect()] == [
        ("Premium", 697, 1201.15), ("Mid-Range", 234, 399.79), ("Budget", 69, 138.96),
    ]
    sums = stored.agg(*(F.sum(c) for c in ("is_peak_hour", "is_high_value", "discount_applied", "is_first_order"))).first()
    assert tuple(sums) == (284, 465, 562, 100)
    assert stored.where("rating <> -1").count() == stored.where("status = 'delivered'").count() == 202
    assert stored.where("payment_method = 'UPI'").count() == 408
