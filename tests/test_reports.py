"""Report invariants on a hand-made star, and price history."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.functions import dates as D
from basketry.functions.money import discount_band, ratio
from basketry.functions.text import slice_key
from basketry.operators import gold
from basketry.plans import catalogue as C, reports as R, views
from basketry.session import local_session
from basketry.sources.star import Star, calendar_dim, enriched_sales, load_star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


@pytest.fixture(scope="module")
def tiny(spark):
    """Four SKUs, two of them level on revenue; one sale a year later; none the year between."""
    d = Decimal
    fact = spark.createDataFrame([
        ("1", "S1", "P", dt.date(1999, 5, 1), 1, d("50.00"), d("50.00"), d("0.00"), d("50.00")),
        ("2", "S2", "P", dt.date(1999, 5, 2), 2, d("15.00"), d("30.00"), d("0.00"), d("30.00")),
        ("3", "S3", "O", dt.date(1999, 5, 3), 3, d("10.00"), d("30.00"), d("0.00"), d("30.00")),
        ("4", "S4", "O", dt.date(2001, 5, 3), 4, d("25.00"), d("100.00"), d("10.00"), d("90.00")),
    ], "transaction_id string, sku_id string, store_id string, transaction_date date, quantity int, "
       "unit_price decimal(10,2), total_amount decimal(12,2), discount_amount decimal(10,2), net_amount decimal(12,2)")
    product = spark.createDataFrame([(f"S{i}", f"n{i}", "cat%" if i < 3 else "dog", "b", Decimal("9.00"), True) for i in (1, 2, 3, 4)],
                                    "sku_id string, product_name string, category string, brand string, list_price decimal(10,2), is_current boolean")
    store = spark.createDataFrame([("P", "p", "R", "physical"), ("O", "o", "R", "online")],
                                  "store_id string, store_name string, region_id string, store_type string")
    region = spark.createDataFrame([("R", "West Side", "USA")], "region_id string, region_name string, country string")
    weather = spark.createDataFrame([("R", dt.date(1999, 5, 1), Decimal("8.00"), Decimal("0.00"), "Sunny", None)],
                                    "region_id string, date date, temperature_avg decimal(5,2), precipitation decimal(8,2), weather_condition string, weather_alert string")
    return Star(enriched_sales(fact, product, store, region), product, store, region, calendar_dim(spark), weather)


def test_pareto_ties_share_rank_and_cumulative_share(tiny):
    got = {r.sku_id: (r.revenue_rank, r.revenue_pct, r.cumulative_revenue_pct) for r in views.sku_revenue_pareto(tiny).collect()}
    assert got == {"S4": (1, 0.45, 0.45), "S1": (2, 0.25, 0.7), "S2": (3, 0.15, 1.0), "S3": (3, 0.15, 1.0)}
    assert R.skus_at_80(tiny).first()[0] == 3
    assert [r.sku_id for r in R.concentration(tiny, 3).collect()] == ["S4", "S1", "S2"]


def test_growth_needs_the_very_year_before(tiny):
    assert [r.yoy_growth_pct for r in R.seasonal_trend(tiny).collect()] == [None, None]


def test_growth_survives_the_year_filter(star):
    full = {(r.year, r.month, r.season): r.yoy_growth_pct for r in R.seasonal_trend(star).collect()}
    one = R.seasonal_trend(star, 2000).collect()
    assert one and all(full[r.year, r.month, r.season] == r.yoy_growth_pct for r in one)
    assert any(r.yoy_growth_pct is not None for r in one)
    assert R.seasonal_trend(star, 1890).collect() == []


def test_filters_take_text_as_text(tiny):
    assert R.revenue_by_category_region(tiny, "CAT%").count() == 1
    assert R.revenue_by_category_region(tiny, "%").count() == 0
    assert R.revenue_by_category_region(tiny, region="r").count() == 3


def test_missing_weather_keeps_the_sale(tiny):
    got = {r.weather_condition: r.transactions for r in C.weather_conditions(tiny).collect()}
    assert got == {"Sunny": 1, None: 3}


def test_trend_is_sorted_with_known_seasons(star):
    rows = R.seasonal_trend(star).collect()
    assert [(r.year, r.month) for r in rows] == sorted((r.year, r.month) for r in rows)
    assert {r.season for r in rows} == {"Spring", "Summer", "Fall", "Winter"}


def test_leakage_rates_and_order(star):
    rows = R.category_leakage(star).collect()
    assert all(0 <= r.discount_rate <= 1 and r.net_revenue <= r.gross_revenue for r in rows)
    assert [r.total_discount for r in rows] == sorted((r.total_discount for r in rows), reverse=True)
    assert R.leakage_summary(star).first() == (rows[0].category, rows[0].discount_rate)


def test_bands_and_lift(star):
    bands = {r.discount_band for r in R.discount_effectiveness(star).collect()}
    assert bands <= {"0%", "0-10%", "10-20%", "20%+"}
    assert {r.higher_discount_lifts_quantity for r in R.band_rollup(star).collect()} <= {True, False}


def test_one_band_has_no_lift(tiny):
    assert [r.higher_discount_lifts_quantity for r in R.band_rollup(tiny, "cat%").collect()] == [None]


def test_cumulative_share_rises_to_one(star):
    rows = views.sku_revenue_pareto(star).orderBy("revenue_rank").collect()
    shares = [r.cumulative_revenue_pct for r in rows]
    assert shares == sorted(shares) and shares[-1] == 1.0 and all(0 <= r.revenue_pct <= 1 for r in rows)


def test_shock_extremes(star):
    zero, full = R.concentration_scenario(star, 10, 0).first(), R.concentration_scenario(star, 10, 100).first()
    assert zero.scenario_total_revenue == zero.baseline_total_revenue and zero.revenue_impact_usd == 0
    assert full.scenario_total_revenue == pytest.approx(full.baseline_total_revenue - full.top_n_revenue_baseline)
    assert full.revenue_impact_usd < 0
    for bad in ((0, 10), (501, 10), (5, -1), (5, 101)):
        with pytest.raises(ValueError):
            R.concentration_scenario(star, *bad)


def test_adhoc_takes_one_select_and_caps_it(spark, star):
    views.register_views(star)
    assert R.adhoc_select(spark, "SELECT * FROM v_sales_by_product;", 7).count() == 7
    assert R.adhoc_select(spark, "with x as (select 1 as a) select * from x").count() == 1
    cut, whole = R.adhoc_select(spark, "SELECT * FROM v_sales_by_product", 7), R.adhoc_select(spark, "SELECT * FROM v_category_leakage", 99)
    assert cut.first().truncated is True and whole.first().truncated is False
    assert R.adhoc_select(spark, "SELECT sku_id FROM v_sales_by_product WHERE product_name <> 'set'", None).columns == ["sku_id"]
    for bad in ("DROP TABLE x", "select 1; select 2", "INSERT INTO t SELECT 1", "with x as (select 1) delete from y", "",
                "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM nowhere",
                "SELECT (SELECT max(p_size) FROM parquet.`/root/testdata/sf0.001/part.parquet`) FROM v_category_leakage"):
        with pytest.raises(ValueError):
            R.adhoc_select(spark, bad)


def test_price_history_merges_repeats_and_looks_up_by_day(spark):
    seen = [("s", dt.date(2000, 1, 1), 10), ("s", dt.date(2000, 2, 1), 10), ("s", dt.date(2000, 3, 1), 12), ("s", dt.date(2000, 3, 1), 12), ("s", dt.date(2000, 4, 1), 10)]
    versions = gold.price_versions(spark.createDataFrame(seen, "sku_id string, effective_date date, list_price int"))
    assert [(r.list_price, str(r.effective_date), str(r.end_date), r.is_current) for r in versions.orderBy("effective_date").collect()] == [
        (10, "2000-01-01", "2000-03-01", False), (12, "2000-03-01", "2000-04-01", False), (10, "2000-04-01", "None", True)]
    fact = spark.createDataFrame([(i, "s", dt.date(2000, m, d)) for i, (m, d) in enumerate([(1, 1), (2, 29), (3, 1), (3, 31), (4, 1)])]
                                 + [(9, "s", dt.date(1999, 12, 31))], "id int, sku_id string, transaction_date date")
    got = {r.id: r.price_as_of for r in gold.price_as_of(fact, versions).collect()}
    assert got == {0: 10, 1: 10, 2: 12, 3: 12, 4: 10}


def test_calendar_edges(spark):
    days = {"2026-03-19": "Winter", "2026-03-20": "Spring", "2026-06-20": "Spring", "2026-06-21": "Summer", "2026-09-22": "Summer",
            "2026-09-23": "Fall", "2026-12-20": "Fall", "2026-12-21": "Winter", "2026-01-01": "Winter"}
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.col("d").cast("date"))
    assert {str(r.d): r.s for r in df.select("d", D.season("d").alias("s")).collect()} == days
    flags = spark.sql("select explode(array(date'2026-11-26', date'2026-12-25', date'2026-01-01', date'2026-03-07', date'2026-03-09')) d")
    assert [r[0] for r in flags.select(D.is_holiday("d")).collect()] == [True, True, True, True, False]
    m = spark.sql("select date'2026-03-17' d").select(*D.month_windows("d")).first()
    assert (str(m.month_start), str(m.month_end), str(m.history_start), m.history_months) == ("2026-03-01", "2026-03-31", "2023-03-01", 36)


def test_band_edges_and_ratio(spark):
    df = spark.createDataFrame([(Decimal("0.00"), Decimal("0.00")), (Decimal("100.00"), Decimal("9.99")), (Decimal("100.00"), Decimal("10.00")),
                                (Decimal("100.00"), Decimal("20.00"))], "total_amount decimal(12,2), discount_amount decimal(10,2)")
    assert [r[0] for r in df.select(discount_band()).collect()] == ["0%", "0-10%", "10-20%", "20%+"]
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0), 2), ratio(F.lit(2), F.lit(3), 4)).first() == (None, 0.6667)


def test_slice_key_is_file_safe(spark):
    assert spark.range(1).select(slice_key(F.lit("Home & Garden"), F.lit("R/1"))).first()[0] == "Home_Garden__R_1"


def test_session_is_shared():
    assert local_session("again", 8) is not None
