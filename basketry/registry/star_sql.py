"""SQL text of the star for the comparison engine, and small SQL builders."""
from __future__ import annotations


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def ratio(a: str, b: str, digits: int) -> str:
    quotient = f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"
    return f"CAST(ROUND(CAST({quotient} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


BAND = (
    "CASE WHEN total_amount = 0 OR discount_amount = 0 THEN '0%' "
    "WHEN discount_amount < total_amount * CAST(0.10 AS DECIMAL(3,2)) THEN '0-10%' "
    "WHEN discount_amount < total_amount * CAST(0.20 AS DECIMAL(3,2)) THEN '10-20%' "
    "ELSE '20%+' END"
)
BAND_ORDER = "CASE discount_band WHEN '0%' THEN 0 WHEN '0-10%' THEN 1 WHEN '10-20%' THEN 2 ELSE 3 END"

CALENDAR = """
calendar_days AS (
  SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS g(d)
),
seasonal_calendar AS (
  SELECT date, dayname(date) AS day_of_week, CAST(isodow(date) AS INTEGER) AS day_of_week_num,
         CAST(weekofyear(date) AS INTEGER) AS week_number, CAST(month(date) AS INTEGER) AS month,
         CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
         (isodow(date) >= 6 OR (month(date) = 12 AND day(date) = 25) OR (month(date) = 1 AND day(date) = 1)
          OR (month(date) = 11 AND day(date) = 26)) AS is_holiday,
         CASE WHEN (month(date), day(date)) BETWEEN (3, 20) AND (6, 20) THEN 'Spring'
              WHEN (month(date), day(date)) BETWEEN (6, 21) AND (9, 22) THEN 'Summer'
              WHEN (month(date), day(date)) BETWEEN (9, 23) AND (12, 20) THEN 'Fall'
              ELSE 'Winter' END AS season,
         CASE dayofyear(date) % 13 WHEN 0 THEN 'Flash Sale' WHEN 5 THEN 'Clearance' WHEN 9 THEN 'Loyalty Week' END
           AS marketing_event
  FROM calendar_days
)"""

DIMS = """
product_master AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         CAST(p_size AS VARCHAR) || ' ct' AS package_size, CAST(p_retailprice AS DECIMAL(10,2)) AS list_price,
         DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS launch_date,
         CASE WHEN p_size > 45 THEN 'inactive' ELSE 'active' END AS status, (p_partkey % 11 <> 0) AS is_current
  FROM part
),
regional_reference AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS region_id, r_name AS region_name,
         (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS country
  FROM region
),
store_reference AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name, CAST(n_regionkey AS VARCHAR) AS region_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'online' ELSE 'physical' END AS store_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
weather_overlay AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS region_id, date,
         CAST(CAST((dayofyear(date) * 11 + r_regionkey * 17 + year(date) * 3) % 450 AS DECIMAL(10,1)) / 10 - 5 AS DECIMAL(5,2)) AS temperature_avg,
         CAST(CAST((dayofyear(date) * 11 + r_regionkey * 17 + year(date) * 3) % 450 AS DECIMAL(10,1)) / 10 - 9 AS DECIMAL(5,2)) AS temperature_min,
         CAST(CAST((dayofyear(date) * 11 + r_regionkey * 17 + year(date) * 3) % 450 AS DECIMAL(10,1)) / 10 AS DECIMAL(5,2)) AS temperature_max,
         CASE WHEN (dayofyear(date) * 7 + r_regionkey * 3 + year(date)) % 10 < 4 THEN 0
              ELSE CAST(((dayofyear(date) * 5 + r_regionkey * 7) % 200) / 10.0 AS DECIMAL(8,2)) END AS precipitation,
         CAST((dayofyear(date) * 3 + r_regionkey) % 101 AS INTEGER) AS humidity,
         CASE WHEN (dayofyear(date) * 7 + r_regionkey * 3 + year(date)) % 10 < 4 THEN 'Sunny'
              WHEN (dayofyear(date) * 7 + r_regionkey * 3 + year(date)) % 10 < 7 THEN 'Rainy'
              WHEN (dayofyear(date) * 7 + r_regionkey * 3 + year(date)) % 10 < 9 THEN 'Cloudy'
              ELSE 'Stormy' END AS weather_condition,
         CASE WHEN (dayofyear(date) * 7 + r_regionkey * 3 + year(date)) % 10 = 9 THEN 'Storm Warning' END AS weather_alert
  FROM region, calendar_days
  WHERE (dayofyear(date) + r_regionkey) % 29 <> 0
)"""

FACT = """
sales_lines AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) AS discount_amount,
         CAST(l_quantity AS INTEGER) AS quantity
  FROM lineitem
  QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC,
                             l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC) = 1
),
sales_transactions AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         CAST(l_partkey AS VARCHAR) AS sku_id, CAST(l_suppkey AS VARCHAR) AS store_id,
         CAST(l_shipdate AS DATE) AS transaction_date, quantity,
         CAST(ROUND(CAST(CAST(total_amount AS DOUBLE) / NULLIF(CAST(quantity AS DOUBLE), 0) AS DECIMAL(38,10)), 2) AS DECIMAL(10,2)) AS unit_price,
         total_amount, discount_amount, CAST(total_amount - discount_amount AS DECIMAL(12,2)) AS net_amount
  FROM sales_lines
)"""

#: Every sale once with all that the dimensions say about it; ``live_sales`` are those of current products.
BASE = """
all_sales AS (
  SELECT f.*, p.product_name, p.category, p.brand, p.list_price, p.is_current, place.store_name, place.store_type,
         place.region_id, place.region_name, place.country, c.* EXCLUDE (date),
         w.temperature_avg, w.precipitation, w.weather_condition, w.weather_alert, w.date IS NOT NULL AS has_weather
  FROM sales_transactions f
  JOIN product_master p USING (sku_id)
  JOIN (SELECT * FROM store_reference JOIN regional_reference USING (region_id)) place USING (store_id)
  JOIN seasonal_calendar c ON c.date = f.transaction_date
  LEFT JOIN weather_overlay w ON w.date = f.transaction_date AND w.region_id = place.region_id
),
live_sales AS (SELECT * FROM all_sales WHERE is_current)"""

_SUMS = """count(*) AS n, sum(quantity) AS units, sum(total_amount) AS gross, sum(discount_amount) AS given, sum(net_amount) AS net"""

VIEWS = f"""
sku_sums AS (
  SELECT sku_id, product_name, category, brand, {_SUMS}, sum(unit_price) AS prices, min(transaction_date) AS since, max(transaction_date) AS until
  FROM all_sales GROUP BY ALL
),
day_sums AS (
  SELECT transaction_date, year, quarter, month, week_number, day_of_week, season, is_holiday, {_SUMS},
         count(DISTINCT store_id) AS stores, count(DISTINCT sku_id) AS skus
  FROM all_sales GROUP BY ALL
),
category_band AS (SELECT category, {BAND} AS discount_band, {_SUMS} FROM live_sales GROUP BY ALL),
v_sales_by_product AS (
  SELECT sku_id, product_name, category, brand, since AS first_sale_date, until AS last_sale_date, {big('n')} AS transaction_count,
         {big('units')} AS total_quantity, {dbl('gross')} AS total_revenue, {dbl('given')} AS total_discount, {dbl('net')} AS net_revenue,
         {ratio('prices', 'n', 6)} AS avg_unit_price
  FROM sku_sums
),
v_sales_by_store_region AS (
  SELECT * EXCLUDE (n, units, gross, given, net), {big('n')} AS transaction_count, {big('units')} AS total_quantity,
         {dbl('gross')} AS total_revenue, {dbl('net')} AS net_revenue
  FROM (SELECT store_id, store_name, store_type, region_id, region_name, country, {_SUMS},
               {big('count(DISTINCT sku_id)')} AS unique_products, {big('count(DISTINCT transaction_date)')} AS active_days
        FROM all_sales GROUP BY ALL)
),
v_daily_sales_summary AS (
  SELECT transaction_date, year, quarter, month, week_number, day_of_week, season, is_holiday, {big('stores')} AS active_stores,
         {big('skus')} AS unique_products, {big('n')} AS transaction_count, {big('units')} AS total_quantity, {dbl('gross')} AS total_revenue,
         {dbl('net')} AS net_revenue, {ratio('net', 'n', 6)} AS avg_transaction_value
  FROM day_sums
),
v_sales_weather_context AS (
  SELECT region_id, region_name, transaction_date, weather_condition, weather_alert, {dbl('temperature_avg')} AS temperature_avg,
         {dbl('precipitation')} AS precipitation, {big('n')} AS transaction_count, {big('units')} AS total_quantity, {dbl('net')} AS total_revenue
  FROM (SELECT region_id, region_name, transaction_date, weather_condition, weather_alert, temperature_avg, precipitation, {_SUMS}
        FROM all_sales GROUP BY ALL)
),
v_monthly_sales_summary AS (
  SELECT year, quarter, month, season, {big('sum(n)')} AS transaction_count, {big('sum(units)')} AS total_quantity,
         {dbl('sum(gross)')} AS total_revenue, {dbl('sum(net)')} AS net_revenue, {ratio('sum(net)', 'sum(n)', 2)} AS avg_transaction_value,
         {dbl('coalesce(sum(net) FILTER (is_holiday), 0)')} AS holiday_net_revenue
  FROM day_sums GROUP BY year, quarter, month, season
),
v_monthly_sales_by_category_region AS (
  SELECT year, month, category, region_id, region_name, {dbl('sum(net_amount)')} AS net_revenue
  FROM live_sales GROUP BY year, month, category, region_id, region_name
),
v_category_leakage AS (
  SELECT category, {big('sum(n)')} AS transaction_count, {big('sum(units)')} AS total_quantity, {dbl('sum(gross)')} AS gross_revenue,
         {dbl('sum(given)')} AS total_discount, {dbl('sum(net)')} AS net_revenue, {ratio('sum(given)', 'sum(gross)', 4)} AS discount_rate,
         {ratio('sum(net)', 'sum(n)', 2)} AS revenue_per_transaction
  FROM category_band GROUP BY category
),
v_discount_effectiveness AS (
  SELECT category, discount_band, {big('n')} AS transaction_count, {ratio('units', 'n', 2)} AS avg_quantity, {ratio('net', 'n', 2)} AS avg_net_amount,
         {dbl('net')} AS net_revenue, {dbl('given')} AS total_discount
  FROM category_band
),
sku_net AS (SELECT sku_id, product_name, category, brand, net FROM sku_sums),
v_sku_revenue_pareto AS (
  SELECT sku_id, product_name, category, brand, {dbl('net')} AS net_revenue, {big('rank() OVER (ORDER BY net DESC)')} AS revenue_rank,
         {ratio('net', 'sum(net) OVER ()', 4)} AS revenue_pct,
         {ratio('sum(net) OVER (ORDER BY net DESC)', 'sum(net) OVER ()', 4)} AS cumulative_revenue_pct
  FROM sku_net
)"""


def star(body: str, *extra: str) -> str:
    """``body`` over the star tables and views, after any further CTEs."""
    ctes = ",".join([CALENDAR, DIMS, FACT, BASE, VIEWS, *extra])
    return f"WITH {ctes}\n{body}"
