"""What the plans must not contain, and what keeps them whole under skew."""

import re

import pytest
from pyspark.sql import functions as F

from tiffinlake.plans import registry, reports
from tiffinlake.sources import orders as src

BATCH = [name for name in registry.QUERIES if re.match(r"q\d|enrich_|derive_|adhoc|status_label|retention", name)]


def executed(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


def planned(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, key", [("customer", "c_custkey"), ("nation", "n_nationkey"), ("part", "p_partkey")])
def test_dimension_keys_are_unique(spark, small, name, key):
    rows = src.read(spark, small, name)
    assert rows.select(key).distinct().count() == rows.count()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_no_python(spark, small, name):
    plan = planned(registry.QUERIES[name](spark, small))
    for forbidden in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "ArrowEval"):
        assert forbidden not in plan


@pytest.mark.parametrize("name", [n for n in BATCH if re.match(r"q\d|adhoc", n)])
def test_reports_read_the_table_and_join_nothing(spark, small, name):
    plan = planned(registry.QUERIES[name](spark, small))
    assert "Join" not in plan and "events.parquet" not in plan and plan.count("FileScan") in (1, 2)


@pytest.mark.parametrize("name, value", [("q7_top_restaurants", "status,delivered"), ("q10_high_value_orders", "is_high_value,1")])
def test_filters_are_pushed_to_the_table(spark, small, name, value):
    plan = planned(registry.QUERIES[name](spark, small))
    assert f"EqualTo({value})" in plan and "EqualTo(status,delivered)" in plan


@pytest.mark.parametrize("name", ["enrich_hour", "enrich_value_category", "enrich_price_per_item", "enrich_flags"])
def test_no_join_where_no_dimension_is_read(spark, small, name):
    plan = planned(registry.QUERIES[name](spark, small))
    assert "Join" not in plan and "customer" not in plan


def test_column_pruning(spark, small):
    plan = planned(registry.QUERIES["q1_totals"](spark, small))
    assert "ReadSchema: struct<price:float>" in plan
    plan = planned(registry.QUERIES["enrich_hour"](spark, small))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp>" in plan


def test_every_part_is_a_restaurant(spark):
    folder = "/root/testdata/sf0.01"
    parts = src.read(spark, folder, "part").count()
    used = src.raw_orders(spark, folder, ["order_id", "items", "restaurant_name"])
    assert parts > 200 and used.where("restaurant_name is null").count() == 0
    assert used.select("items").distinct().count() == src.read(spark, folder, "part").select("p_name").distinct().count()


@pytest.mark.parametrize("name", [n for n in BATCH if n.startswith("enrich_") or n.startswith("derive_")])
def test_row_by_row_steps_do_not_shuffle(spark, small, name):
    # The number of parts is a subquery, one row of partial counts.
    plan = re.sub(r"Subquery .*?(?=FileScan parquet [^\n]*events|FileScan parquet [^\n]*p_name|\Z)", "", planned(registry.QUERIES[name](spark, small)), flags=re.S)
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_groups_are_summed_before_the_shuffle(spark, small):
    plan = planned(registry.QUERIES["q2_city_revenue"](spark, small))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum(try_cast(price" in plan and "TakeOrderedAndProject" in plan


def test_share_scans_once_and_gathers_no_groups(spark, small):
    plan = executed(registry.QUERIES["q4_status_share"](spark, small))
    final = re.split(r"^\+- == Initial Plan ==", plan, flags=re.M)[0]
    own, subquery = re.split(r"Subquery subquery.*\n.*\n.*== Final Plan ==", final)
    subquery = subquery.split("== Initial Plan ==")[0]
    assert "Window" not in plan
    assert "ReusedExchange" in subquery and "FileScan" not in subquery


def test_session_zone_does_not_matter(spark, small, settings):
    expected = registry.QUERIES["enrich_full"](spark, small).collect()
    settings({"spark.sql.session.timeZone": "Asia/Kolkata"})
    assert registry.QUERIES["enrich_full"](spark, small).collect() == expected


def test_a_shuffle_moves_events_and_not_orders(spark, small, settings):
    """What is computed of an event is computed after the customers are joined."""
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
    lines = planned(registry.QUERIES["derive_orders"](spark, small)).splitlines()
    top = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(user_id" in line)
    moved = "\n".join(lines[top : top + 3])
    assert "percentile" in moved and "event_type" in moved
    for late in ("ord-", "+91", "delivered", "UPI"):
        assert late not in moved


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of all events belong to one customer, and as many to none."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    i = F.col("id")
    spark.range(0, 300_000, numPartitions=16).select(
        i.alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=i)).alias("ts"),
        F.when(i % 3 == 0, 7).when(i % 3 == 1, F.lit(None)).otherwise(i % 2000).cast("bigint").alias("user_id"),
        F.lit("purchase").alias("event_type"),
        F.lit('{"k": 5}').alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    spark.range(0, 2000).select(
        i.alias("c_custkey"), i.cast("string").alias("c_name"), (i % 25).cast("int").alias("c_nationkey"),
        F.lit("M").alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 25).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), i).alias("n_name")).write.parquet(
        f"{folder}/nation.parquet"
    )
    spark.range(0, 200).select(
        i.alias("p_partkey"), F.lit("p").alias("p_name"), F.concat(F.lit("b"), i).alias("p_brand"), F.lit("t").alias("p_type")
    ).write.parquet(f"{folder}/part.parquet")
    return folder


def test_hot_customer_without_broadcast(spark, skewed, settings):
    """Customers too large to broadcast: the hot partition is split, and no row is lost."""
    report = reports.city_revenue(registry.food_orders(spark, skewed, ["city", "price"]))
    broadcast = report.collect()
    settings(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        }
    )
    report = reports.city_revenue(registry.food_orders(spark, skewed, ["city", "price"]))
    plan = executed(report)
    assert "skew=true" in plan
    assert [r["city"] for r in report.collect()] == [r["city"] for r in broadcast]
    assert [r["orders"] for r in report.collect()] == [r["orders"] for r in broadcast]
    full = registry.QUERIES["derive_orders"](spark, skewed)
    assert full.count() == 300_000
    assert full.where("city is null").count() == 100_000


def test_a_missing_dimension_row_drops_no_order(spark, skewed):
    assert registry.food_orders(spark, skewed, ["order_id"]).count() == 300_000
    assert registry.food_orders(spark, skewed, ["city"]).count() == 300_000
