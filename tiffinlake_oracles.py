"""DuckDB SQL for the registered queries, over the given tables only.

It is written apart from the library: the hour, for one, comes from the
calendar functions of DuckDB and not from arithmetic on milliseconds.
"""

from __future__ import annotations

RAW = """
raw AS (
    SELECT 'ord-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS order_id,
           epoch_us(ts) // 1000 AS "timestamp",
           c_name AS customer_name,
           '+91' || lpad(CAST(user_id * 7919 % 1000000 AS VARCHAR), 10, '0') AS customer_phone,
           n_name AS city,
           c_mktsegment AS area,
           p_brand AS restaurant_name,
           p_type AS cuisine,
           p_name AS items,
           CAST(1 + event_id % 6 AS INTEGER) AS quantity,
           CAST(CAST(8000 + event_id * 7919 % 172001 AS DOUBLE) / 100 AS FLOAT) AS price,
           CASE event_type WHEN 'view' THEN 'placed' WHEN 'click' THEN 'preparing'
                WHEN 'signup' THEN 'out_for_delivery' WHEN 'purchase' THEN 'delivered'
                ELSE 'cancelled' END AS status,
           CASE WHEN k < 40 THEN 'UPI' WHEN k < 60 THEN 'Credit Card' WHEN k < 75 THEN 'Debit Card'
                WHEN k < 90 THEN 'Cash on Delivery' WHEN k < 95 THEN 'Net Banking'
                ELSE 'Wallet' END AS payment_method,
           CAST(15 + event_id % 51 AS INTEGER) AS delivery_time_mins,
           CASE WHEN event_type = 'purchase'
                THEN CAST(CAST(30 + event_id % 21 AS DOUBLE) / 10 AS FLOAT) END AS rating,
           user_id % 2 = 0 AS discount_applied,
           event_id % 10 = 0 AS is_first_order,
           event_id, ts
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) e
    LEFT JOIN customer ON user_id = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN part ON p_partkey = event_id % (SELECT COUNT(*) FROM part)
)"""

RAW_NAMES = """order_id, "timestamp", customer_name, customer_phone, city, area, restaurant_name,
    cuisine, items, quantity, price, status, payment_method, delivery_time_mins, rating,
    discount_applied, is_first_order"""


def enriched(source: str, name: str, hour: str = "hour(ts)") -> str:
    """The computed columns over the CTE `source`."""
    return f"""
{name} AS (
    SELECT * REPLACE (CASE WHEN discount_applied THEN 1 ELSE 0 END AS discount_applied,
                      CASE WHEN is_first_order THEN 1 ELSE 0 END AS is_first_order),
           CASE WHEN hour_of_day IN (12, 13, 14, 19, 20, 21, 22) THEN 1 ELSE 0 END AS is_peak_hour,
           CASE WHEN price < 200 THEN 'Budget' WHEN price < 600 THEN 'Mid-Range'
                ELSE 'Premium' END AS order_value_category,
           CAST(CAST(price AS DOUBLE) / nullif(quantity, 0) AS FLOAT) AS price_per_item,
           CASE WHEN price >= 1000 THEN 1 ELSE 0 END AS is_high_value
    FROM (SELECT *, CAST({hour} AS INTEGER) AS hour_of_day FROM {source})
)"""


ENRICHED_NAMES = f"""{RAW_NAMES},
    hour_of_day, is_peak_hour, order_value_category, price_per_item, is_high_value"""
ORDERS = f"WITH {RAW}, {enriched('raw', 'food_orders')}"
ALL_ORDERS = f"{ORDERS} SELECT {ENRICHED_NAMES} FROM food_orders"

# What ten kinds of damage leave of the messages of cancelled orders: the
# first four make them unreadable, the others cost one field.
DAMAGED = f"""
kinds AS (SELECT *, CASE WHEN status = 'cancelled' THEN event_id % 10 ELSE -1 END AS kind FROM raw),
readable AS (
    SELECT * REPLACE (
        CASE WHEN kind IN (4, 6) THEN NULL ELSE quantity END AS quantity,
        CASE WHEN kind = 5 THEN NULL ELSE price END AS price,
        CASE WHEN kind = 7 THEN NULL ELSE discount_applied END AS discount_applied,
        CASE WHEN kind = 8 THEN NULL ELSE "timestamp" END AS "timestamp",
        CASE WHEN kind = 8 THEN NULL ELSE ts END AS ts,
        CASE WHEN kind = 9 THEN NULL ELSE items END AS items)
    FROM kinds WHERE kind NOT BETWEEN 0 AND 3
),
received AS (
    SELECT * FROM readable
    UNION ALL BY NAME
    SELECT kind FROM kinds WHERE kind BETWEEN 0 AND 3
)"""
DAMAGED_ORDERS = f"WITH {RAW}, {DAMAGED}, {enriched('received', 'food_orders')}"

STORED_NAMES = ENRICHED_NAMES
for _name, _default in {
    "quantity": "0", "price": "CAST(0 AS FLOAT)", "delivery_time_mins": "0", "rating": "CAST(-1 AS FLOAT)",
    "hour_of_day": "0", "price_per_item": "CAST(0 AS FLOAT)",
}.items():
    STORED_NAMES = STORED_NAMES.replace(f" {_name},", f" coalesce({_name}, {_default}) AS {_name},")

LAST_DAY = """ "timestamp" >= (SELECT max("timestamp") FROM food_orders) - 24 * 60 * 60 * 1000"""

# A sum to the cent.
MONEY = "CAST(SUM(TRY_CAST(price AS DECIMAL(18,2))) AS DOUBLE)"

# The reports, in SQL that both engines read; a report with a limit breaks ties.
REPORTS = {
    "q1_totals": f"SELECT COUNT(*) AS total_orders, {MONEY} AS total_revenue FROM food_orders",
    "q2_city_revenue": f"""
        SELECT city, COUNT(*) AS orders, {MONEY} AS revenue, ROUND(AVG(price), 2) AS avg_order_value
        FROM food_orders GROUP BY city ORDER BY revenue DESC, city LIMIT 10""",
    "q3_cuisine_popularity": """
        SELECT cuisine, COUNT(*) AS orders, ROUND(AVG(price), 2) AS avg_price
        FROM food_orders GROUP BY cuisine""",
    "q4_status_share": """
        SELECT status, COUNT(*) AS count,
               ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct
        FROM food_orders GROUP BY status""",
    "q5_payment_mix": f"""
        SELECT payment_method, COUNT(*) AS orders, {MONEY} AS total_revenue
        FROM food_orders GROUP BY payment_method""",
    "q6_peak_offpeak": """
        SELECT is_peak_hour, COUNT(*) AS orders, ROUND(AVG(price), 2) AS avg_price,
               ROUND(AVG(delivery_time_mins), 1) AS avg_delivery_mins
        FROM food_orders GROUP BY is_peak_hour""",
    "q7_top_restaurants": f"""
        SELECT restaurant_name, COUNT(*) AS orders, {MONEY} AS total_revenue, ROUND(AVG(rating), 2) AS avg_rating
        FROM food_orders WHERE status = 'delivered'
        GROUP BY restaurant_name ORDER BY total_revenue DESC, restaurant_name LIMIT 10""",
    "q8_value_category": """
        SELECT order_value_category, COUNT(*) AS orders, ROUND(AVG(price), 2) AS avg_price
        FROM food_orders GROUP BY order_value_category""",
    "q9_hourly_volume": "SELECT hour_of_day, COUNT(*) AS orders FROM food_orders GROUP BY hour_of_day",
    "q10_high_value_orders": """
        SELECT restaurant_name, city, cuisine, price, rating FROM food_orders
        WHERE is_high_value = 1 AND status = 'delivered' ORDER BY price DESC, order_id LIMIT 10""",
    "adhoc_sql": """
        SELECT city, status, COUNT(*) AS orders,
               ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS pct,
               ROUND(AVG(price_per_item), 2) AS avg_item_price
        FROM food_orders WHERE is_peak_hour = 1 OR is_first_order = 1
        GROUP BY city, status HAVING COUNT(*) > 1""",
}

def _column(*names: str) -> str:
    return f"{ORDERS} SELECT order_id, {', '.join(names)} FROM food_orders"


# The table holds defaults for nulls.
STORED = f"{ORDERS}, kept AS (SELECT {STORED_NAMES}, event_id, ts FROM food_orders)"

SQL = {name: f"{STORED} SELECT * FROM ({text.replace('FROM food_orders', 'FROM kept')})" for name, text in REPORTS.items()} | {
    "q9_last_24h": f"""{ORDERS} SELECT hour_of_day, COUNT(*) AS orders
        FROM food_orders WHERE {LAST_DAY} GROUP BY hour_of_day""",
    "running_totals_by_order": f"""{ORDERS} SELECT order_id, "timestamp", COUNT(*) OVER w AS total_orders,
        CAST(SUM(CAST(price AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total_revenue
        FROM food_orders WINDOW w AS (ORDER BY "timestamp", order_id ROWS UNBOUNDED PRECEDING)""",
    "live_totals": f"{ORDERS} {REPORTS['q1_totals']}",
    "live_city_revenue": f"""{ORDERS} SELECT city, COUNT(*) AS orders, {MONEY} AS revenue,
        ROUND(AVG(price), 2) AS avg_order_value FROM food_orders GROUP BY city""",
    "live_peak_offpeak": f"{ORDERS} SELECT * FROM ({REPORTS['q6_peak_offpeak']})",
    "live_cuisine_orders": f"{ORDERS} SELECT * FROM ({REPORTS['q3_cuisine_popularity']})",
    "live_status_share": f"{ORDERS} SELECT * FROM ({REPORTS['q4_status_share']})",
    "live_top_restaurants": f"{ORDERS} SELECT * FROM ({REPORTS['q7_top_restaurants']})",
    "enrich_hour": _column("hour_of_day"),
    "enrich_peak": _column("is_peak_hour"),
    "enrich_local_hours": f"""
        WITH {RAW}, {enriched('raw', 'food_orders', 'hour(ts + INTERVAL 330 MINUTE)')}
        SELECT order_id, hour_of_day, is_peak_hour FROM food_orders""",
    "enrich_value_category": _column("order_value_category"),
    "enrich_price_per_item": _column("price_per_item"),
    "enrich_high_value": _column("is_high_value"),
    "enrich_flags": _column("discount_applied", "is_first_order"),
    "enrich_full": ALL_ORDERS,
    "status_label": f"""{ORDERS} SELECT order_id, status,
        coalesce(map(['placed', 'preparing', 'out_for_delivery', 'delivered', 'cancelled'],
                     ['📥', '👨‍🍳', '🛵', '✅', '❌'])[status], '❓') AS label FROM food_orders""",
    "derive_orders": f"WITH {RAW} SELECT {RAW_NAMES} FROM raw",
    "derive_items": "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ', ') AS items FROM part",
    "publish_batch": f"WITH {RAW} SELECT order_id AS key, {RAW_NAMES} FROM raw",
    "decode_orders": f"WITH {RAW} SELECT {RAW_NAMES} FROM raw",
    "decode_malformed": f"{DAMAGED_ORDERS} SELECT {ENRICHED_NAMES} FROM food_orders",
    "encode_envelope": f"{ORDERS} SELECT order_id AS key, {ENRICHED_NAMES} FROM food_orders",
    "conform_defaults": f"{DAMAGED_ORDERS} SELECT {STORED_NAMES} FROM food_orders",
    "retention_1d": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders WHERE {LAST_DAY}",
    "table_scan": f"""{ORDERS} SELECT {STORED_NAMES}, CAST(ts AS DATE) AS order_date FROM food_orders
        WHERE status = 'delivered' AND price >= 200""",
    "table_index_scan": f"""{ORDERS} SELECT order_id, city, payment_method, cuisine, price, status FROM food_orders
        WHERE payment_method = 'Debit Card' AND city = (SELECT max(n_name) FROM nation)""",
    "table_expire": f"""{ORDERS} SELECT {STORED_NAMES}, CAST(ts AS DATE) AS order_date FROM food_orders
        WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM food_orders)""",
    "table_compact": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders",
    "catalog_table": f"""{ORDERS} SELECT CAST(ts AS DATE) AS order_date, status, COUNT(*) AS orders,
        CAST(SUM(is_high_value) AS BIGINT) AS high_value FROM food_orders GROUP BY ALL""",
    "stream_enrich_append": ALL_ORDERS,
    "stream_ingest_table": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders",
    "ingest_two_topics": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders",
    "ingest_repeated_topic": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders",
    "stream_progress": """SELECT 'enrichment' AS name, COUNT(*) AS input_rows FROM events
        UNION ALL SELECT 'ingestion', COUNT(*) FROM events""",
    "live_last_24h": """SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, COUNT(*) AS orders FROM events
        WHERE date_trunc('minute', ts) > (SELECT date_trunc('minute', max(ts)) - INTERVAL 1 DAY FROM events)
        GROUP BY hour_of_day""",
    "stream_restart": f"{ORDERS} SELECT {STORED_NAMES} FROM food_orders",
}
