"""Business reports over the views, without the models."""
from __future__ import annotations

import re
from decimal import Decimal

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketry.functions.money import BAND_ORDER, dbl, lookup, ratio, rounded, sum_of
from basketry.functions.text import same_text
from basketry.operators.ordered import exact_medians, modes
from basketry.plans import views
from basketry.session import spool
from basketry.sources.star import Star


WIDE = "decimal(28,2)"


def seasonal_trend(star: Star, year: int | None = None) -> DataFrame:
    """Monthly rows with growth over the same month and season a year before.

    Growth is taken before the year filter, so a single year still has a basis.
    """
    monthly = views.monthly_sales_summary(star)
    # A range frame of exactly one year back: a missing year gives NULL, as it should.
    year_before = Window.partitionBy("month", "season").orderBy("year").rangeBetween(-1, -1)
    prev = F.max("net_revenue").over(year_before)
    growth = rounded(F.try_divide(F.col("net_revenue") - prev, prev) * 100, 2).cast("double")
    out = monthly.withColumn("yoy_growth_pct", growth)
    if year is not None:
        out = out.filter(F.col("year") == year)
    return out.orderBy("year", "month", "season")


def season_rollup(star: Star, year: int | None = None) -> DataFrame:
    days = views.daily_totals(star)
    if year is not None:
        days = days.filter(F.col("year") == year)
    return days.groupBy("season").agg(sum_of("net").alias("net_revenue"))


def revenue_by_category_region(star: Star, category: str | None = None, region: str | None = None,
                               year: int | None = None) -> DataFrame:
    out = views.monthly_category_region(star)
    if category is not None:
        out = out.filter(same_text("category", category))
    if region is not None:
        out = out.filter(same_text("region_name", region) | same_text("region_id", region))
    if year is not None:
        out = out.filter(F.col("year") == year)
    return out.orderBy("category", "region_name", "year", "month")


def category_leakage(star: Star, category: str | None = None) -> DataFrame:
    out = views.category_leakage(star)
    if category is not None:
        out = out.filter(same_text("category", category))
    return out.orderBy(F.desc("total_discount"), "category")


def leakage_summary(star: Star, category: str | None = None) -> DataFrame:
    """The category that loses most to discounts, and its rate."""
    top = F.max_by(F.struct("category", "discount_rate"), F.struct("total_discount", "category"))
    return category_leakage(star, category).agg(top.alias("t")).select(
        F.col("t.category").alias("highest_leakage_category"),
        F.col("t.discount_rate").alias("highest_discount_rate"),
    )


def discount_effectiveness(star: Star, category: str | None = None) -> DataFrame:
    out = views.discount_effectiveness(star)
    if category is not None:
        out = out.filter(same_text("category", category))
    return out.orderBy("category", "discount_band")


def band_rollup(star: Star, category: str | None = None) -> DataFrame:
    """Transaction-weighted quantity per band, and whether the last band beats the first."""
    weighted = F.sum(F.col("avg_quantity").cast("decimal(18,2)") * F.col("transaction_count"))
    bands = (
        discount_effectiveness(star, category).groupBy("discount_band")
        .agg(ratio(weighted, F.sum("transaction_count"), 2).alias("band_avg_quantity"))
        .withColumn("_o", lookup("discount_band", BAND_ORDER, 9))
    )
    every_band = Window.partitionBy()  # at most four rows
    last = F.max_by("band_avg_quantity", "_o").over(every_band)
    first = F.min_by("band_avg_quantity", "_o").over(every_band)
    lifts = F.when(F.count("*").over(every_band) >= 2, last > first)
    return bands.select("discount_band", "band_avg_quantity", lifts.alias("higher_discount_lifts_quantity"))


def concentration(star: Star, top_n: int = 10) -> DataFrame:
    if not 1 <= top_n <= 500:
        raise ValueError("top_n must be within 1..500")
    return views.sku_revenue_pareto(star).orderBy("revenue_rank", "sku_id").limit(top_n)


def skus_at_80(star: Star) -> DataFrame:
    """Revenue rank at which the rounded cumulative share first reaches 80 %."""
    return (
        views.sku_revenue_pareto(star).filter(F.col("cumulative_revenue_pct") >= 0.80)
        .agg(F.min("revenue_rank").alias("skus_covering_80pct_revenue"))
    )


def concentration_summary(star: Star, top_n: int = 10) -> DataFrame:
    """The leading SKU, its share, and how many SKUs make 80 % of revenue, in one pass."""
    first = F.min_by(F.struct("product_name", "revenue_pct"), F.struct("revenue_rank", "sku_id"))
    reach = F.min(F.when(F.col("cumulative_revenue_pct") >= 0.80, F.col("revenue_rank")))
    return views.sku_revenue_pareto(star).agg(first.alias("t"), reach.alias("skus_covering_80pct_revenue")).select(
        F.col("t.product_name").alias("top_sku"), F.col("t.revenue_pct").alias("top_sku_revenue_pct"),
        "skus_covering_80pct_revenue", F.lit(top_n).alias("top_n"))


def concentration_scenario(star: Star, top_n: int = 10, shock_pct: float = 20.0) -> DataFrame:
    """Effect on total revenue when the top SKUs lose ``shock_pct`` per cent."""
    if not 1 <= top_n <= 500 or not 0 <= shock_pct <= 100:
        raise ValueError("top_n must be within 1..500 and shock_pct within 0..100")
    per_sku = star.sales.groupBy("sku_id").agg(F.sum("net_amount").alias("net"))
    none = F.lit(None).cast("decimal(38,2)")
    top = per_sku.orderBy(F.desc("net"), "sku_id").limit(top_n).select(F.col("net").alias("top"), none.alias("net"))
    # Two labelled branches summed together: no join is needed for two totals.
    both = per_sku.select(none.alias("top"), "net").unionByName(top)
    sums = both.agg(F.coalesce(F.sum("net"), F.lit(0)).cast(WIDE).alias("total"),
                    F.coalesce(F.sum("top"), F.lit(0)).cast(WIDE).alias("top"))
    keep = F.lit(1 - Decimal(str(shock_pct)) / 100).cast("decimal(9,6)")
    shocked = F.round(F.col("top") * keep, 2).cast(WIDE)
    impact = shocked - F.col("top")
    return sums.select(
        F.lit(top_n).alias("top_n"),
        F.lit(float(shock_pct)).alias("shock_pct"),
        dbl("total").alias("baseline_total_revenue"),
        dbl("top").alias("top_n_revenue_baseline"),
        dbl(shocked).alias("top_n_revenue_shocked"),
        dbl(F.col("total") + impact).alias("scenario_total_revenue"),
        dbl(impact).alias("revenue_impact_usd"),
        F.coalesce(ratio(impact * 100, "total", 2), F.lit(0.0)).alias("revenue_impact_pct"),
    )


def category_features(star: Star) -> DataFrame:
    """Typical sale of each category, the input of the what-if predictions.

    ``mode_is_holiday`` and ``latest_month`` are maxima, as their readers expect.
    """
    by = ["category"]
    current = star.sales.filter("is_current")
    medians = exact_medians(current, by, {
        "median_list_price": F.col("list_price"),
        "median_unit_price": F.col("unit_price"),
        "actual_discount_rate": F.coalesce(ratio("discount_amount", "total_amount", 6), F.lit(0.0)),
    })
    # The label columns have few values, so one small table of counts serves them all.
    labels = spool(
        current.groupBy(*by, "store_type", "brand", "transaction_date").agg(F.count("*").alias("n"))
        .join(star.calendar, F.col("transaction_date") == F.col("date"))
        .groupBy(*by, "store_type", "brand", "season", "month", "quarter", "is_holiday",
                 F.coalesce("marketing_event", F.lit("none")).alias("event"))
        .agg(F.sum("n").alias("n")),
        "labels",
    )
    out = labels.groupBy(*by).agg(
        F.max("month").alias("latest_month"),
        F.max("quarter").alias("latest_quarter"),
        F.max(F.col("is_holiday").cast("int")).alias("mode_is_holiday"),
    ).join(medians, by)
    for column, name in (("store_type", "mode_store_type"), ("brand", "mode_brand"),
                         ("season", "mode_season"), ("event", "mode_marketing_event")):
        out = out.join(modes(labels, by, F.col(column), name, F.col("n")), by, "left")
    return out


_READ_ONLY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


def _relations(spark: SparkSession, body: str) -> tuple[set[str], set[str]]:
    """Names a query reads and names its own CTEs, from the parsed and not yet resolved plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body).toString()
    read = set(re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan))
    defined = {name for names in re.findall(r"CTE \[([^\]]*)\]", plan) for name in re.split(r",\s*", names)}
    return read, defined


def adhoc_select(spark: SparkSession, text: str, max_rows: int | None = 200) -> DataFrame:
    """One read-only SELECT over the registered views.

    With ``max_rows`` the result is cut there and says so: ``truncated`` is true in every row when
    the query has more.  ``None`` gives all rows, without that column.  What may be read
    follows from the parsed relations: temporary views and the query's own CTEs, nothing else.
    """
    body = text.strip().rstrip(";").strip()
    if not _READ_ONLY.match(body):
        raise ValueError("only a single SELECT statement is accepted")
    try:
        read, defined = _relations(spark, body)
    except ParseException as e:
        raise ValueError("only a single SELECT statement is accepted") from e
    views_ = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    foreign = {r for r in read if r.lower() not in views_ | {d.lower() for d in defined}}
    if foreign:
        raise ValueError(f"not a registered view: {', '.join(sorted(foreign))}")
    rows = spark.sql(body)
    if max_rows is None:
        return rows
    numbered = rows.limit(max_rows + 1)
    more = numbered.agg((F.count("*") > max_rows).alias("more"))
    return numbered.limit(max_rows).withColumn("truncated", more.scalar())


# ------------------------------------------------------------ dashboard roll-ups

def month_year_totals(star: Star) -> DataFrame:
    """Net revenue per month; joins the two season rows of a turning month."""
    return (
        views.daily_totals(star).groupBy("year", "month")
        .agg(sum_of("net").alias("net_revenue")).orderBy("year", "month")
    )


def band_share(star: Star, category: str | None = None) -> DataFrame:
    bands = (
        star.sales.filter("is_current")
        .filter(F.lit(True) if category is None else same_text("category", category))
        .groupBy(views.discount_band().alias("discount_band")).agg(F.sum("net_amount").alias("net"))
    )
    total = F.sum("net").over(Window.partitionBy())  # at most four rows
    return bands.select(
        "discount_band", lookup("discount_band", BAND_ORDER, 9).alias("band_order"),
        dbl("net").alias("net_revenue"), ratio("net", total, 4).alias("share"),
    ).orderBy("band_order")


def history_breakdown(star: Star, category: str | None = None, region: str | None = None) -> DataFrame:
    """Monthly history by region when a category is fixed, else by category."""
    dim = "region_name" if category is not None else "category"
    sales = star.sales.filter("is_current")
    if category is not None:
        sales = sales.filter(same_text("category", category))
    if region is not None:
        sales = sales.filter(same_text("region_name", region) | same_text("region_id", region))
    order = F.year("transaction_date") * 100 + F.month("transaction_date")
    return (
        sales.groupBy(F.col(dim).alias("group_dim"), order.alias("month_order"))
        .agg(sum_of("net_amount").alias("net_revenue")).orderBy("month_order", "group_dim")
    )
