"""SQL text of the canonical feed rows, straight from the order lines."""
from __future__ import annotations

from basketry.registry.star_sql import CALENDAR, DIMS

NOW = "TIMESTAMP '2001-06-30 12:00:00'"

LINES = """
feed_lines AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) AS discount_dec,
         CAST(ROUND(CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) / l_quantity AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS price_dec,
         CASE l_suppkey % 3 WHEN 0 THEN 'online_channel' WHEN 1 THEN 'pos_system_a' ELSE 'pos_system_b' END AS source_system,
         CASE WHEN l_orderkey % 89 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source_txn_id
  FROM lineitem
),
canonical AS (
  SELECT source_system, source_txn_id,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL
              WHEN l_orderkey % 17 = 0 THEN l_shipdate - INTERVAL 40 DAY + to_hours(l_linenumber)
              ELSE l_shipdate + to_hours(l_linenumber) END AS txn_timestamp,
         CAST(l_partkey AS VARCHAR) AS sku, quantity,
         CASE WHEN l_orderkey % 83 = 0 THEN NULL
              WHEN source_system = 'online_channel'
                THEN round_even(CAST(total_amount AS DOUBLE) * CAST(0.73 AS DOUBLE) / quantity * 100, 0) / 100
              ELSE CAST(price_dec AS DOUBLE) END AS unit_price,
         CASE WHEN source_system = 'online_channel' THEN CAST(discount_dec AS DOUBLE) * CAST(0.73 AS DOUBLE)
              ELSE CAST(discount_dec AS DOUBLE) END AS discount_amount,
         CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS store_id,
         source_system || '_' || strftime(l_shipdate, '%Y%m') AS batch_id,
         l_shipdate + to_microseconds(CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * 100) AS BIGINT)) AS ingested_at,
         l_partkey * 1000000 + l_suppkey % 1000000 AS ingest_seq,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS batch_month
  FROM feed_lines
),
known_product AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id FROM part WHERE p_size <= 45)"""

_RULES = [
    ("txn_timestamp IS NULL", "txn_timestamp:not_nullable"),
    (f"txn_timestamp > {NOW} + INTERVAL 1 DAY", "txn_timestamp:txn_timestamp_in_future"),
    ("quantity <= 0", "quantity:quantity_not_positive"),
    ("unit_price IS NULL", "unit_price:not_nullable"),
    ("unit_price < 0", "unit_price:unit_price_negative"),
    ("discount_amount < 0", "discount_amount:discount_negative"),
    ("store_id IS NULL", "store_id:not_nullable"),
]
REASON = "NULLIF(concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _RULES) + "), '')"

CHECKED = f"""
checked AS (SELECT *, {REASON} AS reject_reason FROM canonical),
valid AS (
  SELECT c.*, p.sku_id IS NULL AS sku_unmatched,
         CAST(date_trunc('month', c.txn_timestamp) AS DATE) < c.batch_month AS late_arrival
  FROM checked c LEFT JOIN known_product p ON c.sku = p.sku_id WHERE c.reject_reason IS NULL
),
ranked AS (
  SELECT *, ROW_NUMBER() OVER w AS rn, FIRST_VALUE(batch_id) OVER w AS kept_batch_id,
         FIRST_VALUE(ingested_at) OVER w AS kept_ingested_at
  FROM valid WINDOW w AS (PARTITION BY source_system, source_txn_id ORDER BY ingested_at DESC, batch_id DESC, ingest_seq DESC)
),
survivors AS (SELECT * FROM ranked WHERE rn = 1)"""

# A batch's winner is loaded when no valid copy of an earlier batch is newer.
MONTHS = """
month_winners AS (
  SELECT *, COUNT(*) OVER (PARTITION BY source_system, source_txn_id, batch_month) AS copies FROM valid
  QUALIFY ROW_NUMBER() OVER (PARTITION BY source_system, source_txn_id, batch_month
                             ORDER BY ingested_at DESC, batch_id DESC, ingest_seq DESC) = 1
),
month_loads AS (
  SELECT w.*, NOT EXISTS (
    SELECT 1 FROM month_winners e WHERE e.source_system = w.source_system AND e.source_txn_id = w.source_txn_id
      AND e.batch_month < w.batch_month
      AND (e.ingested_at, e.batch_id, e.ingest_seq) >= (w.ingested_at, w.batch_id, w.ingest_seq)) AS loaded
  FROM month_winners w
),
gold_rows AS (
  SELECT * FROM month_loads
  WHERE loaded AND NOT sku_unmatched AND store_id IN (SELECT store_id FROM store_reference)
    AND CAST(txn_timestamp AS DATE) IN (SELECT date FROM seasonal_calendar)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY source_system, source_txn_id ORDER BY batch_month) = 1
)"""


def in_two_batches(query: str) -> str:
    """The run queries with two loads, before and from 2001, instead of one per month."""
    load = "CASE WHEN l_shipdate < TIMESTAMP '2001-01-01 00:00:00' THEN 1 ELSE 2 END AS load"
    query = query.replace("AS batch_month\n  FROM feed_lines", f"AS batch_month, {load}\n  FROM feed_lines")
    head, tail = query.split("month_winners AS (")
    return head + "month_winners AS (" + tail.replace("batch_month", "load")


def text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def micros(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


DEALT = "CASE l_suppkey % 3 WHEN 0 THEN 'online_channel' WHEN 1 THEN 'pos_system_a' ELSE 'pos_system_b' END AS source_system"


def one_feed(body: str, source: str) -> str:
    """All lines in the shape of one feed."""
    assert DEALT in LINES
    return f"WITH {LINES.replace(DEALT, repr(source) + ' AS source_system')}\n{body}"


def feeds(body: str, *extra: str) -> str:
    return "WITH " + ",".join([CALENDAR, DIMS, LINES, CHECKED, MONTHS, *extra]) + "\n" + body
