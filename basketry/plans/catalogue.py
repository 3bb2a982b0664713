"""Named answers to the catalogue of business questions."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions.dates import SEASON_ORDER
from basketry.functions.money import big, count_of, dbl, lookup, ratio, sum_of
from basketry.operators.latest import top_k_per_key
from basketry.plans import views
from basketry.sources.star import Star

NET = "net_revenue"


def _net() -> Column:
    return sum_of("net_amount").alias(NET)


def _avg_net() -> Column:
    return ratio(F.sum("net_amount"), F.count("transaction_id"), 2).alias("avg_transaction_value")


def _dated(star: Star, *columns: str) -> DataFrame:
    """Sales with calendar attributes; the calendar side is small by construction."""
    return star.sales.join(star.calendar.select("date", *columns), F.col("transaction_date") == F.col("date"))


def _in_years(sales: DataFrame, *years: int) -> DataFrame:
    """Year filter on the directory column, so other years are never listed or read."""
    return sales.filter(F.col("sale_year").isin(*years))


# ------------------------------------------------------------- product, brand

def products_by_revenue(star: Star, n: int = 10, lowest: bool = False) -> DataFrame:
    per_sku = star.sales.groupBy("sku_id").agg(F.sum("net_amount").alias("net"))
    order = F.asc("net") if lowest else F.desc("net")
    return (
        per_sku.join(star.product.select("sku_id", "product_name", "category"), "sku_id")
        .orderBy(order, "sku_id").limit(n)
        .select("sku_id", "product_name", "category", dbl("net").alias(NET))
    )


def by_attribute(star: Star, *columns: str) -> DataFrame:
    """Questions about products count current ones only; others count every sale."""
    of_product = set(columns) & {"category", "brand"}
    sales = star.sales.filter("is_current") if of_product else star.sales
    return sales.groupBy(*columns).agg(_net()).orderBy(F.desc(NET), *columns)


def category_quarter(star: Star, year: int, quarter: int) -> DataFrame:
    sales = _in_years(star.sales.filter("is_current"), year).filter(F.quarter("transaction_date") == quarter)
    return sales.groupBy("category").agg(_net()).orderBy(F.desc(NET), "category")


def category_transactions(star: Star, category: str) -> DataFrame:
    return star.sales.filter(F.col("is_current") & (F.col("category") == category)).agg(count_of().alias("transaction_count"))


def trailing_top_products(star: Star, as_of: dt.date, days: int = 30, n: int = 10) -> DataFrame:
    since = F.date_sub(F.lit(as_of), days)
    first_year = (as_of - dt.timedelta(days=days)).year
    recent = star.sales.filter("is_current").filter(
        F.col("sale_year").between(first_year, as_of.year)
        & (F.col("transaction_date") >= since) & (F.col("transaction_date") <= F.lit(as_of))
    )
    per_sku = recent.groupBy("sku_id").agg(
        F.sum("net_amount").alias("net"), F.sum("quantity").alias("qty"), F.count("*").alias("n")
    )
    return (
        per_sku.join(star.product.select("sku_id", "product_name", "category"), "sku_id")
        .orderBy(F.desc("net"), "sku_id").limit(n)
        .select("sku_id", "product_name", "category", dbl("net").alias("revenue"),
                big("qty").alias("units_sold"), big("n").alias("transactions"))
    )


def category_products(star: Star, category: str) -> DataFrame:
    """The product view of one category; the filter reaches the fact scan."""
    return views.sales_by_product(star.where(F.col("category") == category)).filter(F.col("category") == category).orderBy(F.desc(NET), "sku_id")


# --------------------------------------------------------------- store, region

def _per_store(star: Star) -> DataFrame:
    return star.sales.groupBy("store_id").agg(
        F.sum("net_amount").alias("net"), F.count("transaction_id").alias("n")
    ).join(star.store.select("store_id", "store_name", "store_type"), "store_id")


def top_stores(star: Star, n: int = 10, by_transactions: bool = False) -> DataFrame:
    order = F.desc("n") if by_transactions else F.desc("net")
    return _per_store(star).orderBy(order, "store_id").limit(n).select(
        "store_id", "store_name", "store_type", big("n").alias("transaction_count"), dbl("net").alias(NET)
    )


def by_store_type(star: Star) -> DataFrame:
    return star.sales.groupBy("store_type").agg(_net(), count_of().alias("transaction_count"))


def avg_transaction_by_store_type(star: Star) -> DataFrame:
    return star.sales.groupBy("store_type").agg(_avg_net())


def region_month(star: Star) -> DataFrame:
    return (
        star.sales.groupBy("region_name", "sale_year", F.month("transaction_date").alias("month"))
        .agg(_net(), count_of().alias("transactions"))
        .withColumnRenamed("sale_year", "year").orderBy("region_name", "year", "month")
    )


def country_stores(star: Star, country: str) -> DataFrame:
    return views.sales_by_store_region(star.where(F.col("country") == country)).orderBy(F.desc(NET), "store_id")


def category_region(star: Star, region_like: str | None = None) -> DataFrame:
    sales = star.sales.filter("is_current")
    if region_like is not None:
        sales = sales.filter(F.col("region_name").ilike(region_like))
    return sales.groupBy("category", "region_name").agg(_net()).orderBy(F.desc(NET), "category", "region_name")


def top_category_per_region(star: Star) -> DataFrame:
    totals = star.sales.filter("is_current").groupBy("region_name", "category").agg(F.sum("net_amount").alias("net"))
    best = top_k_per_key(totals, ["region_name"], [F.desc("net"), F.asc("category")], 1)
    return best.select("region_name", "category", dbl("net").alias(NET)).orderBy(F.desc(NET), "region_name")


# ---------------------------------------------------------------------- time

def monthly_of_year(star: Star, year: int) -> DataFrame:
    return (
        _in_years(star.sales, year).groupBy(F.month("transaction_date").alias("month"))
        .agg(_net()).orderBy("month")
    )


def by_quarter(star: Star) -> DataFrame:
    return (
        star.sales.groupBy(F.col("sale_year").alias("year"), F.quarter("transaction_date").alias("quarter"))
        .agg(_net()).orderBy("year", "quarter")
    )


def year_compare(star: Star, *years: int) -> DataFrame:
    return (
        _in_years(star.sales, *years).groupBy(F.col("sale_year").alias("year")).agg(_net()).orderBy("year")
    )


def by_season(star: Star) -> DataFrame:
    return views.daily_totals(star).groupBy("season").agg(sum_of("net").alias(NET)).orderBy(F.desc(NET))


def season_by_year(star: Star) -> DataFrame:
    return (
        views.daily_totals(star).groupBy("season", "year").agg(
            big(F.sum("n")).alias("transactions"), sum_of("net").alias("revenue"),
            ratio(F.sum("net"), F.sum("n"), 6).alias("avg_transaction_value"),
        ).orderBy("year", lookup("season", SEASON_ORDER, 9))
    )


def holiday_compare(star: Star) -> DataFrame:
    return views.daily_totals(star).groupBy("is_holiday").agg(
        big(F.sum("n")).alias("transactions"), big(F.sum("qty")).alias("units"), sum_of("net").alias("revenue"),
        ratio(F.sum("net"), F.sum("n"), 6).alias("avg_transaction_value"),
    )


def best_weekday(star: Star) -> DataFrame:
    """Average of the daily totals per weekday, best first."""
    return (
        views.daily_totals(star).groupBy("day_of_week")
        .agg(ratio(F.sum("net"), F.count("*"), 2).alias("avg_daily_revenue"), big(F.count("*")).alias("days"))
        .orderBy(F.desc("avg_daily_revenue"))
    )


def marketing_events(star: Star) -> DataFrame:
    return (
        views.daily_totals(star).filter("marketing_event is not null").groupBy("marketing_event")
        .agg(ratio(F.sum("net"), F.count("*"), 2).alias("avg_daily_revenue"), big(F.count("*")).alias("days"))
        .orderBy(F.desc("avg_daily_revenue"))
    )


# ------------------------------------------------------------------- weather

def _region_days(star: Star, *extra: str) -> DataFrame:
    """Exact sums per region and day, the grain of the weather table."""
    return star.sales.groupBy("transaction_date", "region_id", "region_name", *extra).agg(
        F.sum("net_amount").alias("net"), F.count("transaction_id").alias("n")
    )


def _with_weather(days: DataFrame, star: Star, how: str) -> DataFrame:
    weather = star.weather.withColumnRenamed("date", "transaction_date")
    return days.join(weather, ["region_id", "transaction_date"], how)


def weather_conditions(star: Star, conditions: list[str] | None = None) -> DataFrame:
    out = _with_weather(_region_days(star), star, "left")
    if conditions is not None:
        out = out.filter(F.col("weather_condition").isin(*conditions))
    return out.groupBy("weather_condition").agg(
        sum_of("net").alias("total_revenue"), big(F.sum("n")).alias("transactions")
    ).orderBy(F.desc("total_revenue"))


def region_weather(star: Star, region_like: str) -> DataFrame:
    days = _region_days(star.where(F.col("region_name").ilike(region_like)))
    return _with_weather(days, star, "left").groupBy("region_name", "weather_condition").agg(
        sum_of("net").alias("total_revenue"), big(F.sum("n")).alias("transactions")
    ).orderBy(F.desc("total_revenue"))


def weather_correlation(star: Star) -> DataFrame:
    """Per condition, averages weighted by transactions."""
    days = _with_weather(_region_days(star), star, "inner")
    return days.groupBy("weather_condition").agg(
        big(F.sum("n")).alias("transactions"), sum_of("net").alias("revenue"),
        ratio(F.sum("net"), F.sum("n"), 6).alias("avg_value"),
        ratio(F.sum(F.col("temperature_avg") * F.col("n")), F.sum("n"), 6).alias("avg_temp"),
        ratio(F.sum(F.col("precipitation") * F.col("n")), F.sum("n"), 6).alias("avg_precip"),
    ).orderBy(F.desc("revenue"))


def temperature_bands(star: Star) -> DataFrame:
    """Average revenue of a region-day in cold, mild and hot weather."""
    t = F.col("temperature_avg")
    band = F.when(t < 10, "cold").when(t <= 25, "mild").otherwise("hot")
    days = _with_weather(_region_days(star), star, "inner").filter(t.isNotNull())
    return days.groupBy(band.alias("temperature_band")).agg(
        ratio(F.sum("net"), F.count("*"), 2).alias("avg_revenue"), big(F.count("*")).alias("region_days")
    )


def region_day_weather(star: Star, since: dt.date) -> DataFrame:
    recent = star.where((F.col("sale_year") >= since.year) & (F.col("transaction_date") >= F.lit(since)))
    return _with_weather(_region_days(recent), star, "left").select(
        "region_name", "transaction_date", "weather_condition", dbl("net").alias("revenue"),
        dbl("temperature_avg").alias("avg_temp"),
    )


def category_weather(star: Star) -> DataFrame:
    days = _region_days(star.where(F.col("is_current")), "category")
    return _with_weather(days, star, "left").groupBy("category", "weather_condition").agg(
        sum_of("net").alias(NET)
    ).orderBy(F.desc(NET), "category")


def hot_wet_days(star: Star, above: float = 25, rain: float = 10) -> DataFrame:
    return (
        views.sales_weather_context(star)
        .filter((F.col("temperature_avg") > above) & (F.col("precipitation") > rain))
        .orderBy("transaction_date", "region_id")
    )
