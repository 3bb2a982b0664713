"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry.registry.all import all_queries
from basketry.session import local_session
from basketry.sources.feeds import SOURCES, landed_feed
from basketry.sources.star import load_star

HEADLINE = [
    "dim_calendar", "dim_insert_calendar_weather", "v_sales_by_product", "v_sales_by_store_region", "v_daily_sales_summary", "v_sales_weather_context",
    "v_monthly_sales_summary", "v_monthly_sales_by_category_region", "v_category_leakage", "v_discount_effectiveness",
    "v_sku_revenue_pareto", "rep_yoy_growth", "rep_category_features", "rep_concentration_scenario",
    "q_category_quarter", "q_top_products", "q_category_weather", "q_top_category_per_region", "q_last_30_days_top10",
    "adapt_union", "val_reason", "dedup_latest", "dedup_audit", "sink_upsert", "backfill", "fact_promote",
    "scd2_asof_price", "feat_history_sample", "ts_slice_series", "ts_order_grid", "ml_train_demand",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors

    registered = all_queries()
    times = {
        "load_star": timed(lambda: load_star(spark, sf_dir)),
        "load_bronze": timed(lambda: [landed_feed(spark, sf_dir, s) for s in SOURCES]),
    }
    for name in HEADLINE:
        build = registered[name].build
        times[name] = timed(lambda: build(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "retail_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
