"""Decoding, enrichment, encoding and null defaults of odd messages."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tiffinlake import schema
from tiffinlake.operators.codec import decode, encode
from tiffinlake.operators.enrich import enrich
from tiffinlake.operators.table import conform
from tiffinlake.sources import files

NOON, EVENING = 1704110400999, 1704135600000

# Payload, then what must come out of it; what is not named must be null, or
# 0 and "Premium" where a computed column knows no null.
CASES = {
    "plain": (
        json.dumps(
            {"order_id": "a", "timestamp": NOON, "quantity": 2, "price": 199.99, "rating": None,
             "discount_applied": True}
        ),
        {"order_id": "a", "timestamp": NOON, "quantity": 2, "price": 199.99, "hour_of_day": 12,
         "is_peak_hour": 1, "order_value_category": "Budget", "price_per_item": 99.995, "discount_applied": 1},
    ),
    "lower bound of a tier": (
        json.dumps({"order_id": "b", "timestamp": EVENING, "quantity": 3, "price": 200, "rating": 4.5}),
        {"order_id": "b", "timestamp": EVENING, "quantity": 3, "price": 200.0, "rating": 4.5,
         "hour_of_day": 19, "is_peak_hour": 1, "order_value_category": "Mid-Range",
         "price_per_item": 66.666664},
    ),
    "bad fields": (
        '{"order_id":"c","quantity":2.5,"price":"x","discount_applied":false}',
        {"order_id": "c"},
    ),
    "no json": ("not json", {}),
    "empty": ("", {}),
    "null": (None, {}),
    "array": ("[1,2]", {}),
    "cut off": ('{"order_id":"t","price":5', {}),
    "extra key, quantity 0, before 1970": (
        '{"order_id":"d","timestamp":-1,"quantity":0,"price":1000.0,"coupon":"X"}',
        {"order_id": "d", "timestamp": -1, "quantity": 0, "price": 1000.0, "hour_of_day": 0,
         "is_high_value": 1},
    ),
    "not a number": (
        '{"order_id":"e","timestamp":1704135600000,"quantity":1,"price":NaN}',
        {"order_id": "e", "timestamp": EVENING, "quantity": 1, "price": math.nan, "hour_of_day": 19,
         "is_peak_hour": 1, "price_per_item": math.nan, "is_high_value": 1},
    ),
    "too large, quoted time": (
        '{"order_id":"f","timestamp":"1704135600000","price":1e39}',
        {"order_id": "f", "price": math.inf, "is_high_value": 1},
    ),
    "quoted numbers": ('{"order_id":"g","quantity":"3","price":"250.5","discount_applied":"true"}', {"order_id": "g"}),
    "time at the end of 64 bits": (
        '{"order_id":"h","timestamp":9223372036854775807}',
        {"order_id": "h", "timestamp": 2**63 - 1},
    ),
}
ALWAYS = {"is_peak_hour": 0, "order_value_category": "Premium", "is_high_value": 0, "discount_applied": 0,
          "is_first_order": 0}


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-6)
    return a == b


def check(row, expected):
    expected = dict.fromkeys(schema.TABLE_COLUMNS) | expected
    wrong = {c: (row[c], expected[c]) for c in schema.TABLE_COLUMNS if not same(row[c], expected[c])}
    assert not wrong


def messages(spark, *payloads):
    rows = [(None, None if p is None else bytearray(p.encode())) for p in payloads]
    return spark.createDataFrame(rows, schema.MESSAGE)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_decode_and_enrich(spark, settings, ansi):
    settings({"spark.sql.ansi.enabled": ansi})
    rows = enrich(decode(messages(spark, *(payload for payload, _ in CASES.values())))).collect()
    assert len(rows) == len(CASES)
    for row, (_, expected) in zip(rows, CASES.values()):
        check(row, ALWAYS | expected)


def test_columns_and_types_of_the_table(spark):
    rows = enrich(decode(messages(spark, "{}")))
    assert rows.columns == schema.TABLE_COLUMNS
    declared = spark.createDataFrame([], schema.FOOD_ORDERS)
    assert dict(rows.dtypes) == dict(declared.dtypes)


def test_roles():
    assert len(schema.RAW_COLUMNS) == 17
    assert len(schema.TABLE_COLUMNS) == 22
    assert len(schema.DIMENSIONS) == 11
    assert [schema.role(c) for c in ("city", "rating", "timestamp")] == ["dimension", "metric", "time"]
    with pytest.raises(KeyError):
        schema.role("coupon")


def test_stored_form_of_odd_messages(spark, tmp_path):
    """Encoding leaves nulls out and the table fills them; NaN is no null."""
    path = str(tmp_path / "processed")
    files.publish(encode(enrich(decode(messages(spark, *(p for p, _ in CASES.values()))))), path)
    stored = conform(files.read_topic(spark, path))
    by_id = {row["order_id"]: row for row in stored.collect() if row["order_id"]}
    for _, expected in CASES.values():
        if "order_id" in expected:
            check(by_id[expected["order_id"]], dict(schema.METRIC_DEFAULTS) | ALWAYS | expected)
    unreadable = stored.where("order_id is null")
    assert unreadable.count() == 5
    for row in unreadable.collect():
        check(row, dict(schema.METRIC_DEFAULTS) | ALWAYS)


def test_default_of_dimensions(spark):
    row = conform(messages(spark, "{}"), dimension_default="null").first()
    assert {row[c] for c in schema.DIMENSIONS} == {"null"}
    assert row["timestamp"] is None
    assert conform(messages(spark, "{}")).first()["city"] is None


def test_envelope(spark):
    orders = enrich(decode(messages(spark, CASES["plain"][0], "not json")))
    first, second = encode(orders).collect()
    assert bytes(first["key"]) == b"a"
    body = json.loads(bytes(first["value"]))
    assert "rating" not in body and body["is_peak_hour"] == 1 and body["price"] == 199.99
    assert second["key"] is None
    assert json.loads(bytes(second["value"])) == ALWAYS
    kept = json.loads(bytes(encode(orders, keep_nulls=True).first()["value"]))
    assert list(kept) == schema.TABLE_COLUMNS and kept["rating"] is None


def test_envelope_does_not_depend_on_the_session(spark, settings):
    settings({"spark.sql.jsonGenerator.ignoreNullFields": "false"})
    body = json.loads(bytes(encode(enrich(decode(messages(spark, "{}")))).first()["value"]))
    assert body == ALWAYS


def test_only_the_columns_read_are_parsed(spark, tmp_path):
    path = str(tmp_path / "raw")
    files.publish(messages(spark, CASES["plain"][0]), path)
    some = decode(files.read_topic(spark, path), columns=["price", "city"])
    assert some.columns == ["city", "price"]
    assert "customer_name" not in some._jdf.queryExecution().optimizedPlan().toString()
    plan = decode(files.read_topic(spark, path)).select("price")._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(price,FloatType" in plan
    assert "customer_name" not in plan
    assert decode(files.read_topic(spark, path)).select(F.sum("price")).first()[0] == pytest.approx(199.99, rel=1e-6)


def test_any_order_survives_the_wire(spark, tmp_path):
    """Random orders with awkward text and numbers come back as they were."""
    draw = random.Random(11)
    alphabet = 'abc "\\/{}[]:,\n\r\t\x00\x1fäßйカ🍛 '

    def text():
        return "".join(draw.choice(alphabet) for _ in range(draw.randrange(12)))

    def real():
        return struct.unpack("f", struct.pack("f", draw.choice([-1, 1]) * 10 ** draw.uniform(-30, 30)))[0]

    kinds = {
        "STRING": text,
        "BIGINT": lambda: draw.randrange(-(2**63), 2**63),
        "INT": lambda: draw.randrange(-(2**31), 2**31),
        "FLOAT": real,
        "BOOLEAN": lambda: draw.random() < 0.5,
    }
    columns = [kinds[field.split()[1]] for field in schema.RAW_ORDER.split(",")]
    rows = [tuple(None if draw.random() < 0.2 else column() for column in columns) for _ in range(2000)]
    orders = spark.createDataFrame(rows, schema.RAW_ORDER)
    for keep_nulls in (True, False):
        path = str(tmp_path / str(keep_nulls))
        files.publish(encode(orders, keep_nulls=keep_nulls), path)
        messages = files.read_topic(spark, path)
        assert sorted(map(repr, decode(messages).collect())) == sorted(map(repr, orders.collect()))
        assert messages.where("key is null").count() == sum(row[0] is None for row in rows)
