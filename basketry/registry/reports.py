"""Views, reports and the question catalogue."""
from __future__ import annotations

import datetime as dt

from basketry.plans import catalogue as C, reports as R
from basketry.plans.views import VIEWS, register_views
from basketry.registry.query import Query
from basketry.registry.star_sql import BAND, BAND_ORDER, big, dbl, ratio, star
from basketry.sources.star import load_star

AS_OF = dt.date(2001, 6, 15)

NET = f"{dbl('SUM(net_amount)')} AS net_revenue"
SALES, LIVE = "FROM all_sales", "FROM live_sales"

DAILY = f"daily_net AS (SELECT transaction_date, day_of_week, marketing_event, SUM(net_amount) AS net {SALES} GROUP BY ALL)"
REGION_DAY = f"""region_day AS (
  SELECT region_id, transaction_date, temperature_avg, SUM(net_amount) AS net {SALES} WHERE has_weather GROUP BY ALL
)"""


def on_star(fn, *args, **kwargs):
    return lambda spark, sf_dir: fn(load_star(spark, sf_dir), *args, **kwargs)


def _adhoc(text: str, max_rows: int):
    def build(spark, sf_dir):
        register_views(load_star(spark, sf_dir))
        return R.adhoc_select(spark, text, max_rows)
    return build


ADHOC = ("SELECT region_name, weather_condition, SUM(transaction_count) AS transactions "
         "FROM v_sales_weather_context WHERE weather_condition IS NOT NULL GROUP BY region_name, weather_condition")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name, build in VIEWS.items():
        q[name] = Query(on_star(build), star(f"SELECT * FROM {name}"))

    # ---- reports
    trend = f"""
      SELECT m.*, {ratio('(m.net_revenue - p.net_revenue) * 100', 'p.net_revenue', 2)} AS yoy_growth_pct
      FROM v_monthly_sales_summary m LEFT JOIN v_monthly_sales_summary p
        ON p.year = m.year - 1 AND p.month = m.month AND p.season = m.season"""
    q["rep_seasonal_trend"] = Query(on_star(R.seasonal_trend, 2000), star(f"SELECT * FROM ({trend}) WHERE year = 2000"))
    q["rep_yoy_growth"] = Query(on_star(R.seasonal_trend), star(trend))
    q["rep_season_rollup"] = Query(
        on_star(R.season_rollup), star(f"SELECT season, {NET} {SALES} GROUP BY season"))
    q["rep_revenue_by_category_region"] = Query(
        on_star(R.revenue_by_category_region, "economy", "asia", 1999),
        star("SELECT * FROM v_monthly_sales_by_category_region WHERE lower(category) = 'economy' "
             "AND (lower(region_name) = 'asia' OR lower(region_id) = 'asia') AND year = 1999"))
    q["rep_category_leakage"] = Query(on_star(R.category_leakage), star("SELECT * FROM v_category_leakage"))
    q["rep_category_leakage_summary"] = Query(on_star(R.leakage_summary), star(
        "SELECT category AS highest_leakage_category, discount_rate AS highest_discount_rate "
        "FROM v_category_leakage ORDER BY total_discount DESC LIMIT 1"))
    rate = ratio("discount_amount", "total_amount", 6)
    med = lambda x: f"CAST(CAST(MEDIAN({dbl(x)}) AS DECIMAL(38,6)) AS DOUBLE)"
    q["rep_category_features"] = Query(on_star(R.category_features), star(f"""
      SELECT category, {med('list_price')} AS median_list_price, {med('unit_price')} AS median_unit_price,
             {med(f'COALESCE({rate}, 0)')} AS actual_discount_rate,
             MODE() WITHIN GROUP (ORDER BY store_type) AS mode_store_type, MODE() WITHIN GROUP (ORDER BY brand) AS mode_brand,
             MODE() WITHIN GROUP (ORDER BY season) AS mode_season, MAX(month) AS latest_month,
             MAX(quarter) AS latest_quarter, MAX(is_holiday::INT) AS mode_is_holiday,
             MODE() WITHIN GROUP (ORDER BY COALESCE(marketing_event, 'none')) AS mode_marketing_event
      {LIVE} GROUP BY category"""))
    q["rep_discount_effectiveness"] = Query(
        on_star(R.discount_effectiveness, "promo"),
        star("SELECT * FROM v_discount_effectiveness WHERE lower(category) = 'promo'"))
    q["rep_band_rollup"] = Query(on_star(R.band_rollup), star(f"""
      SELECT discount_band, band_avg_quantity,
             CASE WHEN COUNT(*) OVER () >= 2 THEN
               arg_max(band_avg_quantity, o) OVER () > arg_min(band_avg_quantity, o) OVER () END AS higher_discount_lifts_quantity
      FROM (SELECT discount_band, {BAND_ORDER} AS o,
              {ratio('SUM(CAST(avg_quantity AS DECIMAL(18,2)) * transaction_count)', 'SUM(transaction_count)', 2)} AS band_avg_quantity
            FROM v_discount_effectiveness GROUP BY discount_band)"""))
    q["rep_concentration_topn"] = Query(
        on_star(R.concentration, 25), star("SELECT * FROM v_sku_revenue_pareto ORDER BY revenue_rank, sku_id LIMIT 25"))
    q["rep_skus_at_80"] = Query(on_star(R.skus_at_80), star(
        "SELECT MIN(revenue_rank) AS skus_covering_80pct_revenue FROM v_sku_revenue_pareto WHERE cumulative_revenue_pct >= 0.80"))
    q["rep_concentration_summary"] = Query(on_star(R.concentration_summary, 10), star("""
      SELECT product_name AS top_sku, revenue_pct AS top_sku_revenue_pct,
             (SELECT MIN(revenue_rank) FROM v_sku_revenue_pareto WHERE cumulative_revenue_pct >= 0.80) AS skus_covering_80pct_revenue,
             10 AS top_n
      FROM v_sku_revenue_pareto ORDER BY revenue_rank, sku_id LIMIT 1"""))
    q["rep_concentration_scenario"] = Query(on_star(R.concentration_scenario, 10, 25.0), star(f"""
      SELECT 10 AS top_n, CAST(25.0 AS DOUBLE) AS shock_pct, {dbl('total')} AS baseline_total_revenue, {dbl('top')} AS top_n_revenue_baseline,
             {dbl('shocked')} AS top_n_revenue_shocked, {dbl('total + shocked - top')} AS scenario_total_revenue,
             {dbl('shocked - top')} AS revenue_impact_usd, {ratio('(shocked - top) * 100', 'total', 2)} AS revenue_impact_pct
      FROM (SELECT total, top, ROUND(CAST(top AS DECIMAL(28,2)) * 0.75, 2) AS shocked
            FROM (SELECT (SELECT SUM(net) FROM sku_net) AS total,
                         (SELECT SUM(net) FROM (SELECT net FROM sku_net ORDER BY net DESC, sku_id LIMIT 10)) AS top))"""))
    q["rep_adhoc_select"] = Query(_adhoc(ADHOC, 200), star(
        ADHOC.replace("SUM(transaction_count)", big("SUM(transaction_count)")).replace(" FROM ", ", FALSE AS truncated FROM ", 1)))

    # ---- dashboard roll-ups
    q["dash_month_year"] = Query(on_star(R.month_year_totals), star(
        f"SELECT year, month, {NET} {SALES} GROUP BY year, month"))
    q["dash_band_share"] = Query(on_star(R.band_share), star(f"""
      SELECT discount_band, CAST({BAND_ORDER} AS INTEGER) AS band_order, {dbl('net')} AS net_revenue,
             {ratio('net', 'SUM(net) OVER ()', 4)} AS share
      FROM (SELECT {BAND} AS discount_band, SUM(net_amount) AS net {LIVE} GROUP BY discount_band)"""))
    q["dash_hist_breakdown"] = Query(on_star(R.history_breakdown, "PROMO"), star(f"""
      SELECT region_name AS group_dim, CAST(year * 100 + month AS INTEGER) AS month_order, {NET}
      {LIVE} WHERE category = 'PROMO' GROUP BY ALL"""))

    # ---- question catalogue
    products = f"SELECT sku_id, product_name, category, net_revenue FROM v_sales_by_product"
    q["q_top_products"] = Query(on_star(C.products_by_revenue), star(f"{products} ORDER BY net_revenue DESC, sku_id LIMIT 10"))
    q["q_bottom_products"] = Query(on_star(C.products_by_revenue, 10, True), star(f"{products} ORDER BY net_revenue, sku_id LIMIT 10"))
    q["q_category_rank"] = Query(on_star(C.by_attribute, "category"), star(f"SELECT category, {NET} {LIVE} GROUP BY category"))
    q["q_brand_rank"] = Query(on_star(C.by_attribute, "brand"), star(f"SELECT brand, {NET} {LIVE} GROUP BY brand"))
    q["q_category_quarter"] = Query(on_star(C.category_quarter, 2000, 4), star(
        f"SELECT category, {NET} {LIVE} WHERE quarter = 4 AND year = 2000 GROUP BY category"))
    stores = f"""SELECT store_id, store_name, store_type, {big('COUNT(*)')} AS transaction_count, {NET}
      {SALES} GROUP BY store_id, store_name, store_type"""
    q["q_top_stores"] = Query(on_star(C.top_stores), star(f"{stores} ORDER BY SUM(net_amount) DESC, store_id LIMIT 10"))
    q["q_store_txn_count"] = Query(on_star(C.top_stores, 10, True), star(f"{stores} ORDER BY COUNT(*) DESC, store_id LIMIT 10"))
    q["q_online_vs_physical"] = Query(on_star(C.by_store_type), star(
        f"SELECT store_type, {NET}, {big('COUNT(*)')} AS transaction_count {SALES} GROUP BY store_type"))
    q["q_avg_txn_by_store_type"] = Query(on_star(C.avg_transaction_by_store_type), star(
        f"SELECT store_type, {ratio('SUM(net_amount)', 'COUNT(*)', 2)} AS avg_transaction_value {SALES} GROUP BY store_type"))
    q["q_region"] = Query(on_star(C.by_attribute, "region_name"), star(
        f"SELECT region_name, {NET} {SALES} GROUP BY region_name"))
    q["q_country"] = Query(on_star(C.by_attribute, "country"), star(
        f"SELECT country, {NET} {SALES} GROUP BY country"))
    q["q_region_month"] = Query(on_star(C.region_month), star(
        f"SELECT region_name, year, month, {NET}, {big('COUNT(*)')} AS transactions {SALES} GROUP BY ALL"))
    q["q_monthly_year"] = Query(on_star(C.monthly_of_year, 1999), star(
        f"SELECT month, {NET} {SALES} WHERE year = 1999 GROUP BY month"))
    q["q_quarter"] = Query(on_star(C.by_quarter), star(
        f"SELECT year, quarter, {NET} {SALES} GROUP BY year, quarter"))
    q["q_year_compare"] = Query(on_star(C.year_compare, 1999, 2000), star(
        f"SELECT year, {NET} {SALES} WHERE year IN (1999, 2000) GROUP BY year"))
    q["q_season"] = Query(on_star(C.by_season), star(f"SELECT season, {NET} {SALES} GROUP BY season"))
    avg6 = ratio("SUM(net_amount)", "COUNT(*)", 6)
    q["q_season_year"] = Query(on_star(C.season_by_year), star(f"""
      SELECT season, year, {big('COUNT(*)')} AS transactions, {dbl('SUM(net_amount)')} AS revenue,
             {avg6} AS avg_transaction_value {SALES} GROUP BY season, year"""))
    q["q_holiday"] = Query(on_star(C.holiday_compare), star(f"""
      SELECT is_holiday, {big('COUNT(*)')} AS transactions, {big('SUM(quantity)')} AS units,
             {dbl('SUM(net_amount)')} AS revenue, {avg6} AS avg_transaction_value {SALES} GROUP BY is_holiday"""))
    q["q_best_weekday"] = Query(on_star(C.best_weekday), star(f"""
      SELECT day_of_week, {ratio('SUM(net)', 'COUNT(*)', 2)} AS avg_daily_revenue, {big('COUNT(*)')} AS days
      FROM daily_net GROUP BY day_of_week""", DAILY))
    q["q_marketing_event"] = Query(on_star(C.marketing_events), star(f"""
      SELECT marketing_event, {ratio('SUM(net)', 'COUNT(*)', 2)} AS avg_daily_revenue, {big('COUNT(*)')} AS days
      FROM daily_net
      WHERE marketing_event IS NOT NULL GROUP BY marketing_event""", DAILY))
    weather = f"""{dbl('SUM(net_amount)')} AS total_revenue, {big('COUNT(*)')} AS transactions {SALES}"""
    q["q_weather_condition"] = Query(on_star(C.weather_conditions), star(
        f"SELECT weather_condition, {weather} GROUP BY weather_condition"))
    q["q_rain_vs_sun"] = Query(on_star(C.weather_conditions, ["Rainy", "Sunny"]), star(
        f"SELECT weather_condition, {weather} WHERE weather_condition IN ('Rainy', 'Sunny') GROUP BY weather_condition"))
    q["q_region_weather"] = Query(on_star(C.region_weather, "%east%"), star(
        f"SELECT region_name, weather_condition, {weather} WHERE region_name ILIKE '%east%' GROUP BY ALL"))
    q["q_weather_corr"] = Query(on_star(C.weather_correlation), star(f"""
      SELECT weather_condition, {big('COUNT(*)')} AS transactions, {dbl('SUM(net_amount)')} AS revenue, {avg6} AS avg_value,
             {ratio('SUM(temperature_avg)', 'COUNT(*)', 6)} AS avg_temp, {ratio('SUM(precipitation)', 'COUNT(*)', 6)} AS avg_precip
      {SALES} WHERE has_weather GROUP BY weather_condition"""))
    q["q_temp_bands"] = Query(on_star(C.temperature_bands), star(f"""
      SELECT CASE WHEN temperature_avg < 10 THEN 'cold' WHEN temperature_avg <= 25 THEN 'mild' ELSE 'hot' END AS temperature_band,
             {ratio('SUM(net)', 'COUNT(*)', 2)} AS avg_revenue, {big('COUNT(*)')} AS region_days
      FROM region_day
      GROUP BY temperature_band""", REGION_DAY))
    q["q_region_day_weather"] = Query(on_star(C.region_day_weather, dt.date(2001, 1, 1)), star(f"""
      SELECT region_name, transaction_date, weather_condition, {dbl('SUM(net_amount)')} AS revenue,
             {dbl('MAX(temperature_avg)')} AS avg_temp
      {SALES} WHERE transaction_date >= DATE '2001-01-01' GROUP BY ALL"""))
    q["q_category_region"] = Query(on_star(C.category_region), star(
        f"SELECT category, region_name, {NET} {LIVE} GROUP BY ALL"))
    q["q_category_region_like"] = Query(on_star(C.category_region, "a%"), star(
        f"SELECT category, region_name, {NET} {LIVE} WHERE region_name ILIKE 'a%' GROUP BY ALL"))
    q["q_category_weather"] = Query(on_star(C.category_weather), star(
        f"SELECT category, weather_condition, {NET} {LIVE} GROUP BY ALL"))
    q["q_top_category_per_region"] = Query(on_star(C.top_category_per_region), star(f"""
      SELECT region_name, category, {dbl('net')} AS net_revenue
      FROM (SELECT region_name, category, SUM(net_amount) AS net {LIVE} GROUP BY ALL)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY region_name ORDER BY net DESC, category) = 1"""))
    q["q_category_txn_count"] = Query(on_star(C.category_transactions, "SMALL"), star(
        f"SELECT {big('COUNT(*)')} AS transaction_count {LIVE} WHERE category = 'SMALL'"))
    q["q_last_30_days_top10"] = Query(on_star(C.trailing_top_products, AS_OF), star(f"""
      SELECT sku_id, product_name, category, {dbl('SUM(net_amount)')} AS revenue,
             {big('SUM(quantity)')} AS units_sold, {big('COUNT(*)')} AS transactions
      {LIVE} WHERE transaction_date BETWEEN DATE '2001-06-15' - 30 AND DATE '2001-06-15'
      GROUP BY sku_id, product_name, category ORDER BY SUM(net_amount) DESC, sku_id LIMIT 10"""))
    q["q_hot_wet_days"] = Query(on_star(C.hot_wet_days), star(
        "SELECT * FROM v_sales_weather_context WHERE temperature_avg > 25 AND precipitation > 10"))
    q["q_category_products"] = Query(on_star(C.category_products, "LARGE"), star(
        "SELECT * FROM v_sales_by_product WHERE category = 'LARGE'"))
    q["q_country_stores"] = Query(on_star(C.country_stores, "NATION_1"), star(
        "SELECT * FROM v_sales_by_store_region WHERE country = 'NATION_1'"))
    return q
