"""The nine analytic views as lazy DataFrames.

Every view aggregates the fact first and joins dimension attributes to the small
result; calendar and weather are joined at day grain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.functions.money import big, count_of, dbl, discount_band, ratio, sum_of
from basketry.operators.ordered import running_totals
from basketry.session import spool
from basketry.sources.star import Star


def _sums() -> list:
    """Additive measures in exact types, for a later second aggregation."""
    return [
        F.count("transaction_id").alias("n"),
        F.sum("quantity").alias("qty"),
        F.sum("total_amount").alias("total"),
        F.sum("discount_amount").alias("disc"),
        F.sum("net_amount").alias("net"),
    ]


def sales_by_product(star: Star) -> DataFrame:
    per_sku = star.sales.groupBy("sku_id").agg(
        *_sums(),
        F.sum("unit_price").alias("price_sum"),
        F.min("transaction_date").alias("first_sale_date"),
        F.max("transaction_date").alias("last_sale_date"),
    )
    return per_sku.join(
        star.product.select("sku_id", "product_name", "category", "brand"), "sku_id"
    ).select(
        "sku_id", "product_name", "category", "brand",
        big("n").alias("transaction_count"),
        big("qty").alias("total_quantity"),
        dbl("total").alias("total_revenue"),
        dbl("disc").alias("total_discount"),
        dbl("net").alias("net_revenue"),
        ratio("price_sum", "n", 6).alias("avg_unit_price"),
        "first_sale_date", "last_sale_date",
    )


def sales_by_store_region(star: Star) -> DataFrame:
    per_store = star.sales.groupBy("store_id").agg(
        *_sums(),
        F.count_distinct("sku_id").alias("unique_products"),
        F.count_distinct("transaction_date").alias("active_days"),
    )
    return (
        per_store
        .join(star.store, "store_id")
        .join(star.region, "region_id")
        .select(
            "store_id", "store_name", "store_type", "region_id", "region_name", "country",
            big("n").alias("transaction_count"),
            big("qty").alias("total_quantity"),
            dbl("total").alias("total_revenue"),
            dbl("net").alias("net_revenue"),
            big("unique_products").alias("unique_products"),
            big("active_days").alias("active_days"),
        )
    )


def daily_sales_summary(star: Star) -> DataFrame:
    """Per day; carries ``year`` because questions about years read this view."""
    per_day = star.sales.groupBy("transaction_date").agg(
        *_sums(),
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("sku_id").alias("skus"),
    )
    return per_day.join(star.calendar, F.col("transaction_date") == F.col("date")).select(
        "transaction_date", "day_of_week", "week_number", "month", "quarter", "year", "season", "is_holiday",
        big("n").alias("transaction_count"),
        big("stores").alias("active_stores"),
        big("skus").alias("unique_products"),
        big("qty").alias("total_quantity"),
        dbl("total").alias("total_revenue"),
        dbl("net").alias("net_revenue"),
        ratio("net", "n", 6).alias("avg_transaction_value"),
    )


def daily_totals(star: Star) -> DataFrame:
    """Day sums with calendar attributes, in exact types."""
    return (
        star.sales.groupBy("transaction_date").agg(*_sums())
        .join(star.calendar, F.col("transaction_date") == F.col("date"))
    )


def sales_weather_context(star: Star) -> DataFrame:
    """Here ``total_revenue`` is the net amount, unlike in the other views."""
    per_day = star.sales.groupBy("transaction_date", "region_id", "region_name").agg(*_sums())
    weather = star.weather.withColumnRenamed("date", "transaction_date")
    return per_day.join(weather, ["region_id", "transaction_date"], "left").select(
        "transaction_date", "region_id", "region_name",
        dbl("temperature_avg").alias("temperature_avg"),
        dbl("precipitation").alias("precipitation"),
        "weather_condition", "weather_alert",
        big("qty").alias("total_quantity"),
        dbl("net").alias("total_revenue"),
        big("n").alias("transaction_count"),
    )


def monthly_sales_summary(star: Star) -> DataFrame:
    """By month and season: a month in which the season turns has two rows."""
    return daily_totals(star).groupBy("year", "month", "quarter", "season").agg(
        big(F.sum("n")).alias("transaction_count"),
        big(F.sum("qty")).alias("total_quantity"),
        sum_of("total").alias("total_revenue"),
        sum_of("net").alias("net_revenue"),
        ratio(F.sum("net"), F.sum("n"), 2).alias("avg_transaction_value"),
        dbl(F.sum(F.when(F.col("is_holiday"), F.col("net")).otherwise(0))).alias("holiday_net_revenue"),
    )


def monthly_category_region(star: Star) -> DataFrame:
    per_day = (
        star.sales.filter("is_current")
        .groupBy("category", "region_id", "region_name", "transaction_date")
        .agg(F.sum("net_amount").alias("net"))
    )
    return (
        per_day.join(star.calendar, F.col("transaction_date") == F.col("date"))
        .groupBy("category", "region_id", "region_name", "year", "month")
        .agg(sum_of("net").alias("net_revenue"))
    )


def category_leakage(star: Star) -> DataFrame:
    return star.sales.filter("is_current").groupBy("category").agg(
        sum_of("total_amount").alias("gross_revenue"),
        sum_of("discount_amount").alias("total_discount"),
        sum_of("net_amount").alias("net_revenue"),
        ratio(F.sum("discount_amount"), F.sum("total_amount"), 4).alias("discount_rate"),
        count_of().alias("transaction_count"),
        big(F.sum("quantity")).alias("total_quantity"),
        ratio(F.sum("net_amount"), F.count("transaction_id"), 2).alias("revenue_per_transaction"),
    )


def discount_effectiveness(star: Star) -> DataFrame:
    return (
        star.sales.filter("is_current")
        .groupBy("category", discount_band().alias("discount_band"))
        .agg(
            count_of().alias("transaction_count"),
            ratio(F.sum("quantity"), F.count("quantity"), 2).alias("avg_quantity"),
            ratio(F.sum("net_amount"), F.count("net_amount"), 2).alias("avg_net_amount"),
            sum_of("net_amount").alias("net_revenue"),
            sum_of("discount_amount").alias("total_discount"),
        )
    )


def sku_revenue_pareto(star: Star) -> DataFrame:
    """Rank, share and cumulative share per SKU; equal revenues share a rank and a total.

    Ranks are taken over distinct revenue values with split running totals, so no
    task ever sorts all SKUs.
    """
    per_sku = spool(star.sales.groupBy("sku_id").agg(F.sum("net_amount").alias("net")), "sku-net")
    values = per_sku.groupBy("net").agg(F.count("*").alias("n"), F.sum("net").alias("s"))
    ranked = running_totals(values, "net", ["n", "s"], descending=True).select(
        "net",
        big(F.col("n_upto") - F.col("n") + 1).alias("revenue_rank"),
        ratio("net", "s_all", 4).alias("revenue_pct"),
        ratio("s_upto", "s_all", 4).alias("cumulative_revenue_pct"),
    )
    return (
        per_sku.join(star.product.select("sku_id", "product_name", "category", "brand"), "sku_id")
        .join(ranked, "net")
        .select(
            "sku_id", "product_name", "category", "brand", dbl("net").alias("net_revenue"),
            "revenue_rank", "revenue_pct", "cumulative_revenue_pct",
        )
    )


VIEWS = {
    "v_sales_by_product": sales_by_product,
    "v_sales_by_store_region": sales_by_store_region,
    "v_daily_sales_summary": daily_sales_summary,
    "v_sales_weather_context": sales_weather_context,
    "v_monthly_sales_summary": monthly_sales_summary,
    "v_monthly_sales_by_category_region": monthly_category_region,
    "v_category_leakage": category_leakage,
    "v_discount_effectiveness": discount_effectiveness,
    "v_sku_revenue_pareto": sku_revenue_pareto,
}


def register_views(star: Star) -> None:
    """Expose the star tables and the views to Spark SQL."""
    spark = star.sales.sparkSession
    star.register(spark)
    for name, build in VIEWS.items():
        build(star).createOrReplaceTempView(name)
