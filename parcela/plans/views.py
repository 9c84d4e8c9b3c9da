"""Stand-ins for the market tables, derived from the given tables.

Each text is SQL that Spark and DuckDB read alike; ``TS`` is the time type without a zone. Spark
runs it in ``view``; the oracle queries take it as a common table expression from ``ctes``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: A posting's payload besides status, price and title.
_REST = """concat('https://portal.example/p-', CAST(p_partkey AS STRING), '.html') AS canonical_url, CAST(CAST('1998-01-01' AS DATE) + CAST(p_partkey % 90 AS INT) AS TS) AS source_modified_at,
          CASE p_partkey % 3 WHEN 0 THEN 'venta' WHEN 1 THEN 'alquiler' END AS operation_type, lower(p_type) AS property_type, concat(p_name, ', ', p_brand) AS description, 'USD' AS price_currency,
          CAST(CASE WHEN p_partkey % 4 = 1 THEN p_size * 10 END AS DECIMAL(18,2)) AS expenses_amount, CASE WHEN p_partkey % 4 = 1 THEN 'ARS' END AS expenses_currency,
          CAST(CASE WHEN p_size % 7 <> 0 THEN 2 * p_size END AS DECIMAL(18,2)) AS surface_total, CAST(1.5 * p_size AS DECIMAL(18,2)) AS surface_covered, 'm2' AS surface_unit,
          CAST(p_size % 6 + 1 AS INT) AS rooms, CAST(p_size % 5 AS INT) AS bedrooms, CAST(p_size % 3 + 1 AS INT) AS bathrooms, CAST(p_size % 2 AS INT) AS toilettes, CAST(p_size % 2 AS INT) AS garages,
          CAST(p_size AS INT) AS antiquity_years, CASE WHEN p_size % 2 = 0 THEN 'Frente' END AS disposition, CASE p_size % 3 WHEN 0 THEN 'Norte' WHEN 1 THEN 'Sur' END AS orientation,
          concat('Street ', CAST(p_size AS STRING)) AS address, p_brand AS neighborhood, 'Rosario' AS city, 'Santa Fe' AS province_name,
          CAST(-34.5 - (p_partkey % 200) * 0.0013 AS DECIMAL(10,6)) AS lat, CAST(-58.3 - (p_partkey % 170) * 0.0017 AS DECIMAL(10,6)) AS lon,
          CASE WHEN p_partkey % 4 <> 0 THEN concat('s', CAST(p_partkey % 40 AS STRING)) END AS seller_id, concat('Seller ', CAST(p_partkey % 40 AS STRING)) AS seller_name, 'inmobiliaria' AS seller_type,
          CASE WHEN p_partkey % 2 = 0 THEN 'extra' END AS extra_data"""

SQL: dict[str, str] = {
    "sources": "SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS code, r_regionkey <> 4 AS enabled FROM {region}",
    "listings": """SELECT p_partkey AS id, p_partkey % 5 AS source_id, CAST(p_partkey AS STRING) AS external_id,
        CASE p_size % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'offline' WHEN 2 THEN 'paused' WHEN 3 THEN 'reserved' ELSE 'unknown' END AS status,
        CASE p_partkey % 3 WHEN 0 THEN 'venta' WHEN 1 THEN 'alquiler' END AS operation_type, lower(p_type) AS property_type, p_name AS title,
        CAST(p_retailprice AS DECIMAL(18,2)) AS price_amount,
        CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'ARS' ELSE 'USD' END AS price_currency,
        CAST(CASE WHEN p_partkey % 4 = 1 THEN p_size * 10 END AS DECIMAL(18,2)) AS expenses_amount,
        CAST(CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN 0 ELSE 2 * p_size END AS DECIMAL(18,2)) AS surface_total,
        CAST(1.5 * p_size AS DECIMAL(18,2)) AS surface_covered,
        CAST(p_size % 6 + 1 AS INT) AS rooms, CAST(p_size % 5 AS INT) AS bedrooms, CAST(p_size % 3 + 1 AS INT) AS bathrooms, CAST(p_size % 2 AS INT) AS garages,
        concat('Street ', CAST(p_size AS STRING)) AS address,
        CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS neighborhood, CASE p_partkey % 2 WHEN 0 THEN 'Capital' ELSE 'Rosario' END AS city,
        CASE p_partkey % 2 WHEN 0 THEN 'Capital Federal' ELSE 'Santa Fe' END AS province_name,
        CAST(CASE WHEN p_partkey % 9 <> 0 THEN -34.5 - (p_partkey % 200) * 0.0013 END AS DECIMAL(10,6)) AS lat,
        CAST(CASE WHEN p_partkey % 10 <> 0 THEN -58.3 - (p_partkey % 170) * 0.0017 END AS DECIMAL(10,6)) AS lon,
        CASE WHEN p_partkey % 4 <> 0 THEN concat('s', CAST(p_partkey % 40 AS STRING)) END AS seller_id, CASE WHEN p_partkey % 8 <> 0 THEN concat('Seller ', CAST(p_partkey % 40 AS STRING)) END AS seller_name,
        CAST(CAST('1995-01-01' AS DATE) + CAST(p_partkey % 2000 AS INT) AS TS) AS first_seen_at,
        CAST(CAST('1999-01-01' AS DATE) + CAST(p_partkey % 300 AS INT) AS TS) AS last_seen_at,
        CAST(CAST('1999-01-01' AS DATE) + CAST(p_partkey % 300 AS INT) AS TS) AS updated_at
        FROM {part}""",
    "snapshots": """SELECT l_orderkey * 100 + l_linenumber AS id, l_partkey AS listing_id, CAST(l_shipdate AS TS) AS captured_at,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS price_amount, CASE WHEN l_returnflag = 'R' THEN 'ARS' ELSE 'USD' END AS price_currency, l_linestatus AS status FROM {lineitem}""",
    "incoming": f"""SELECT l.* FROM (
        SELECT p_partkey % 5 AS source_id, CAST(p_partkey AS STRING) AS external_id, 'active' AS status, CASE WHEN p_partkey % 10 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price_amount, concat(p_name, ' (seen)') AS generated_title, {_REST},
          CAST(floor(p_partkey / 20) AS INT) AS page, CAST(p_partkey % 20 AS INT) AS position FROM {{part}} WHERE p_partkey % 17 <> 0
        UNION ALL SELECT p_partkey % 5, concat('new-', CAST(p_partkey AS STRING)), 'active', p_retailprice, concat(p_name, ' (new)'), {_REST}, 9999, CAST(p_partkey AS INT) FROM {{part}} WHERE p_partkey <= 100
        UNION ALL SELECT p_partkey % 5, CAST(p_partkey AS STRING), 'paused', p_retailprice, concat(p_name, ' (paused)'), {_REST}, 10000, CAST(p_partkey AS INT) FROM {{part}} WHERE p_partkey % 101 = 0) l""",
    "current_entities": f"""SELECT p_partkey + 5000000 AS id, p_partkey % 5 AS source_id, CAST(p_partkey AS STRING) AS external_id, 'active' AS status, CAST(p_retailprice AS DECIMAL(18,2)) AS price_amount, p_name AS generated_title, {_REST},
        CAST('1998-01-01 00:00:00' AS TS) AS first_seen_at, CAST('1998-06-01 00:00:00' AS TS) AS last_seen_at, CAST('1998-03-01 00:00:00' AS TS) AS last_changed_at FROM {{part}}""",
    "segments": """SELECT c_custkey AS id, 'portal' AS portal, c_mktsegment AS operation_key, CAST(c_nationkey AS STRING) AS province_key, CAST(c_custkey % 5 AS INT) AS depth,
        CAST((c_custkey % CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END) * (16000 / CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END) AS DOUBLE) AS price_min,
        CAST((c_custkey % CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END + 1) * (16000 / CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END) AS DOUBLE) AS price_max,
        CAST(0 AS DOUBLE) AS surface_min, CAST(1000 AS DOUBLE) AS surface_max, CAST(c_custkey * 7 % 2600 AS INT) AS total_count,
        c_custkey % 5 <> 0 AS is_leaf, c_custkey % 37 = 0 AS is_oversized, CASE WHEN c_custkey % 23 = 0 THEN 'inactive' ELSE 'active' END AS status,
        CASE WHEN c_custkey % 2 = 1 THEN (c_custkey % 70) / 1000.0E0 END AS churn_ewma, CAST(CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 4 WHEN c_custkey % 10 = 0 THEN 3 ELSE 0 END AS INT) AS churn_samples,
        CASE WHEN c_custkey % 2 = 1 THEN CAST(CAST('1998-01-10' AS DATE) + CAST(c_custkey % 20 AS INT) AS TS) END AS last_churn_observed_at,
        CAST('1998-01-01 00:00:00' AS TS) AS created_at, CAST('1998-02-01 00:00:00' AS TS) AS updated_at FROM {customer}""",
    "segment_snapshots": "SELECT o_orderkey AS id, o_custkey AS segment_id, CAST(o_orderdate AS TS) AS captured_at, CAST(floor(o_totalprice / 1000) AS INT) AS total_count FROM {orders}",
    "scan_queue": """SELECT c_custkey + 100000 AS id, c_custkey AS segment_id, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'complete' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'running' END ELSE 'complete' END AS status,
        CASE c_custkey % 9 WHEN 0 THEN 'high' WHEN 1 THEN 'refresh_hot' WHEN 2 THEN 'full_scan_compare' WHEN 3 THEN 'full_scan_baseline' WHEN 4 THEN 'normal' WHEN 5 THEN 'refresh_unknown' WHEN 6 THEN 'refresh_warm' WHEN 7 THEN 'refresh_cold' END AS priority,
        CAST(c_custkey % 4 AS INT) AS attempt_count, CASE WHEN c_custkey % 3 = 0 THEN concat('batch_id=b', CAST(c_custkey % 5 AS STRING), ';tier=hot') END AS reason,
        CAST(c_custkey % 50 AS INT) AS requests_total, CAST(c_custkey % 7 AS INT) AS requests_failed, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 900 AS DOUBLE) END AS avg_latency_ms,
        CAST(c_custkey % 50 - c_custkey % 7 AS INT) AS requests_success, CAST(c_custkey % 83 AS INT) AS listings_found, CAST(c_custkey % 11 AS INT) AS new_count, CAST(c_custkey % 6 AS INT) AS changed_count,
        CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 900 + c_custkey % 70 AS DOUBLE) END AS max_latency_ms, c_custkey % 31 = 0 AS cooldown_triggered,
        CASE WHEN c_custkey % 6 <> 5 THEN CAST(CAST('1998-03-01' AS DATE) + CAST(c_custkey % 40 AS INT) AS TS) END AS completed_at,
        CASE WHEN c_custkey % 4 = 2 THEN CAST(CAST('1998-04-01' AS DATE) + CAST(c_custkey % 20 AS INT) AS TS) END AS locked_at,
        CAST(CAST('1998-03-05' AS DATE) + CAST(c_custkey % 30 AS INT) AS TS) AS updated_at, CAST('1998-01-01 00:00:00' AS TS) AS created_at FROM {customer}""",
    "scan_history": """SELECT event_id AS id, user_id AS segment_id, CAST(ts AS TS) AS scanned_at, CAST(event_id % 40 AS INT) AS new_count, CAST(event_id % 15 AS INT) AS changed_count,
        CAST(CASE WHEN event_id % 19 = 0 THEN 0 ELSE 60 + event_id % 90 END AS INT) AS listings_found, CAST(200 + event_id * 13 % 400 AS INT) AS total_count,
        CASE WHEN event_id % 10 = 0 THEN 'full_scan_baseline' WHEN event_id % 3 = 0 THEN 'refresh_hot' ELSE 'normal' END AS priority, concat('b', CAST(event_id % 5 AS STRING)) AS batch_id FROM {events}""",
    "errors": """SELECT event_id AS id, user_id % 5 AS source_id, CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 500 END AS http_status,
        CASE event_id % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'http' WHEN 2 THEN 'timeout' ELSE 'block' END AS error_type, CAST(ts AS TS) AS failed_at FROM {events} WHERE event_type = 'error'""",
    "requests": """SELECT event_id AS id, user_id AS segment_id, CAST(ts AS TS) AS requested_at, CASE event_id % 8 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS http_status,
        CASE WHEN event_id % 8 <> 3 THEN CAST(event_id % 700 AS DOUBLE) END AS latency_ms FROM {events}""",
    "runs": """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'facts' ELSE 'location' END AS run_type,
        CASE c_custkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'stopping' END ELSE 'queued' END AS status, CAST(c_custkey % 3 AS BIGINT) AS source_id,
        CAST(CAST('1998-01-01' AS DATE) + CAST(c_custkey % 90 AS INT) AS TS) AS started_at,
        CASE WHEN c_custkey % 5 < 3 THEN CAST(CAST('1998-01-02' AS DATE) + CAST(c_custkey % 90 AS INT) AS TS) END AS finished_at FROM {customer}""",
    "pages_seen": "SELECT l_suppkey AS segment, l_linenumber + CAST(l_orderkey % 6 AS INT) * 7 AS page, l_partkey % 30 AS item FROM {lineitem}",
    "catalog_pages": "SELECT user_id AS catalog, event_id AS page, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('view', 'click') THEN 'empty' ELSE 'ok' END AS result FROM {events}",
    "tree_rows": "SELECT concat(l_returnflag, l_linestatus) AS root, l_extendedprice AS price, l_quantity AS surface FROM {lineitem}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in as a DataFrame."""
    text = SQL[name].replace(" AS TS)", " AS TIMESTAMP_NTZ)")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def ctes(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named stand-ins for DuckDB, then of further queries by name."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', SQL[n]).replace(' AS TS)', ' AS TIMESTAMP)')})" for n in names]
    return "WITH " + ", ".join([*parts, *[f"{n} AS ({q})" for n, q in (more or {}).items()]]) + " "
