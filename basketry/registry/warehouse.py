"""Dimensions, fact promotion, product history and integrity checks."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions import dates as D
from basketry.functions.money import big, dbl, sum_of
from basketry.functions.text import slice_key
from basketry.operators import gold, silver as S
from basketry.operators.history import PriceHistory
from basketry.plans import months, views
from basketry.registry.feeds import (
    FACT_SQL, LATEST_PRODUCT, NOW, PRODUCT_LANDING, canonical, fact_select, fresh, known_product, passing, product_landing, valid_rows,
)
from basketry.registry.feeds_sql import feeds
from basketry.registry.query import Query
from basketry.registry.star_sql import big as sql_big, dbl as sql_dbl, ratio, star
from basketry.session import configure, discard, spool
from basketry.sources import sinks
from basketry.sources.feeds import FEED_SCHEMAS, SOURCES, landed_feed
from basketry.sources.star import calendar_dim, calendar_over, load_star, product_dim, region_dim, store_dim, table, weather_dim


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))


# ---------------------------------------------------------------- dimensions

def dim_product(spark, sf_dir):
    """The latest landing fills the dimension; a second build adds nothing."""
    path = fresh(spark, "dim-product")
    for _ in range(2):
        sinks.insert_absent(spark, gold.product_from_landing(product_landing(spark, sf_dir)), path, ["sku_id"])
    return spark.read.parquet(path).select("sku_id", "product_name", "category", "brand", "package_size",
                                           dbl("list_price").alias("list_price"), "launch_date", "status", "is_current")


def _reference_landing(spark, sf_dir) -> DataFrame:
    """One combined row per store with its region, landed twice."""
    both = store_dim(spark, sf_dir).join(region_dim(spark, sf_dir), "region_id")
    first = both.withColumn("ingested_at", F.lit("2001-01-01 00:00:00").cast("timestamp"))
    later = both.filter("store_type = 'online'").withColumns({
        "store_name": F.concat("store_name", F.lit(" (moved)")),
        "ingested_at": F.lit("2001-02-01 00:00:00").cast("timestamp")})
    return first.unionByName(later)


def dim_region_store_split(spark, sf_dir):
    configure(spark)
    region, store = gold.split_region_store(_reference_landing(spark, sf_dir))
    cols = lambda kind, *c: [F.lit(kind).alias("kind"), *[F.col(x).alias(n) for x, n in zip(c, ("id", "name", "attribute"))]]
    return region.select(*cols("region", "region_id", "region_name", "country")).unionByName(
        store.select(*cols("store", "store_id", "store_name", "store_type")))


def dim_calendar(spark, sf_dir):
    return calendar_over(ship_days(spark, sf_dir), "day")


def cal_season(spark, sf_dir):
    days = ship_days(spark, sf_dir).groupBy("day").agg(big(F.count("*")).alias("lines"))
    return days.groupBy(D.month_day("day").alias("month_day"), D.season("day").alias("season")).agg(big(F.sum("lines")).alias("lines"))


def cal_holiday(spark, sf_dir):
    days = ship_days(spark, sf_dir).groupBy("day").agg(big(F.count("*")).alias("lines"))
    return days.select("day", D.is_holiday("day").alias("is_holiday"), "lines")


def cal_month_windows(spark, sf_dir):
    months = ship_days(spark, sf_dir).groupBy(D.month_start("day").alias("m")).agg(big(F.count("*")).alias("lines"))
    return months.select(*D.month_windows("m"), "lines")


def cal_fiscal_quarter(spark, sf_dir):
    configure(spark)
    months = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(big(F.count("*")).alias("orders"))
    return months.select("month", D.fiscal_quarter("month").alias("fiscal_quarter"), "orders")


def dim_insert_calendar_weather(spark, sf_dir):
    """Early years first, then everything: only the missing days are added."""
    configure(spark)
    out = None
    cal = calendar_over(ship_days(spark, sf_dir), "day")
    for name, df, keys in (("seasonal_calendar", cal, ["date"]), ("weather_overlay", weather_dim(spark, sf_dir), ["region_id", "date"])):
        path = fresh(spark, name)
        first = sinks.insert_absent(spark, df.filter(F.year("date") < 1999), path, keys)
        second = sinks.insert_absent(spark, df, path, keys)
        one = spark.read.parquet(path).agg(
            F.lit(name).alias("dimension"), F.lit(first).cast("bigint").alias("first_insert"),
            F.lit(second).cast("bigint").alias("second_insert"), big(F.count("*")).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def dim_counts(spark, sf_dir):
    s = load_star(spark, sf_dir)
    return gold.dim_counts({"product_master": s.product, "regional_reference": s.region, "store_reference": s.store,
                            "seasonal_calendar": s.calendar, "weather_overlay": s.weather})


# ---------------------------------------------------------------------- fact

def _silver(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    return S.as_silver(S.latest(valid_rows(spark, sf_dir, rows)))


def _shown(fact: DataFrame) -> DataFrame:
    return fact.select("transaction_id", "sku_id", "store_id", "transaction_date", "quantity",
                       *[dbl(c).alias(c) for c in ("unit_price", "total_amount", "discount_amount", "net_amount")])


def fact_measures(spark, sf_dir):
    return _shown(gold.fact_rows(_silver(spark, sf_dir)))


def _promotable(spark, sf_dir) -> DataFrame:
    return gold.promotable(_silver(spark, sf_dir), known_product(spark, sf_dir), store_dim(spark, sf_dir), calendar_dim(spark))


def fact_promote(spark, sf_dir):
    return _shown(gold.fact_rows(_promotable(spark, sf_dir)))


def fact_idempotent(spark, sf_dir):
    lake = S.Lake(fresh(spark, "promote"))
    taken = spool(passing(spark, sf_dir), "taken")
    silver = spool(_silver(spark, sf_dir, taken), "survivors")
    discard(taken)
    dims = known_product(spark, sf_dir), store_dim(spark, sf_dir), calendar_dim(spark)
    first, second = (gold.promote(spark, lake, silver, *dims) for _ in range(2))
    return gold.fact_table(spark, lake).read().agg(
        F.lit(first).cast("bigint").alias("first_promotion"), F.lit(second).cast("bigint").alias("second_promotion"),
        big(F.count("*")).alias("fact_rows"))


PROMOTABLE = """promotable AS (
  SELECT * FROM survivors WHERE NOT sku_unmatched AND store_id IN (SELECT store_id FROM store_reference)
    AND CAST(txn_timestamp AS DATE) IN (SELECT date FROM seasonal_calendar)
)"""


ETL_MONTHS = [dt.date(1998, 3, 1), dt.date(1998, 4, 1)]


def month_lake(spark, sf_dir) -> S.Lake:
    """Two months of native feeds, landed, cleaned and promoted one after the other."""
    configure(spark)
    lake = S.Lake(fresh(spark, "months"))
    for month in ETL_MONTHS:
        # Rows arrive in the order of their time, so "latest" means the same row on every run.
        feeds_of = {
            s: landed_feed(spark, sf_dir, s).filter(F.col("batch_month") == F.lit(month)).orderBy("ingested_at", "ingest_seq")
            .select(*FEED_SCHEMAS[s].names) for s in SOURCES}
        months.run_month(spark, lake, feeds_of, month, known_product(spark, sf_dir), store_dim(spark, sf_dir), calendar_dim(spark), NOW)
    return lake


def _month_star(spark, sf_dir):
    """The star over the two months' fact; the session's own fact is not needed for it."""
    return months.star_from_lake(spark, month_lake(spark, sf_dir), product_dim(spark, sf_dir), store_dim(spark, sf_dir),
                                 region_dim(spark, sf_dir), calendar_dim(spark), weather_dim(spark, sf_dir))


def etl_category_leakage(spark, sf_dir):
    """From landing to report: category leakage over the fact that two monthly runs have left."""
    star_ = _month_star(spark, sf_dir)
    return views.category_leakage(star_)


def etl_monthly_summary(spark, sf_dir):
    star_ = _month_star(spark, sf_dir)
    return views.monthly_sales_summary(star_)


# ------------------------------------------------------------ product history

def price_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yearly list price per product; in some years it stays the same."""
    configure(spark)
    y = F.col("y")
    step = F.floor((F.col("p_partkey") + y) / 2) % 3
    return (
        table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"))
        .select(F.col("p_partkey").cast("string").alias("sku_id"),
                (F.col("p_retailprice").cast("decimal(10,2)") + (step * 10).cast("decimal(10,2)")).cast("decimal(10,2)").alias("list_price"),
                F.make_date(y, F.lit(1), F.lit(1)).alias("effective_date"))
    )


HISTORY = """sightings AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku_id, CAST(p_retailprice AS DECIMAL(10,2)) + 10 * (((p_partkey + y) // 2) % 3) AS list_price,
         make_date(y, 1, 1) AS effective_date
  FROM part, generate_series(1995, 2001) AS g(y)
),
changes AS (
  SELECT * FROM sightings
  QUALIFY lag(list_price) OVER (PARTITION BY sku_id ORDER BY effective_date) IS NULL
       OR lag(list_price) OVER (PARTITION BY sku_id ORDER BY effective_date) <> list_price
),
versions AS (
  SELECT *, lead(effective_date) OVER (PARTITION BY sku_id ORDER BY effective_date) AS end_date FROM changes
)"""
VERSION = f"sku_id, {sql_dbl('list_price')} AS list_price, effective_date, end_date, end_date IS NULL AS is_current"


def _versions(spark, sf_dir):
    return gold.price_versions(price_sightings(spark, sf_dir))


def scd2_history(spark, sf_dir):
    return _versions(spark, sf_dir).select("sku_id", dbl("list_price").alias("list_price"), "effective_date", "end_date", "is_current")


def scd2_incremental(spark, sf_dir):
    """The same history from three runs that bring the years out of order."""
    history = PriceHistory(spark, fresh(spark, "history"), buckets=8)
    sightings = price_sightings(spark, sf_dir)
    for run, years in enumerate(((1997, 2001), (1995, 1998), (1996, 1999, 2000))):
        history.absorb(sightings.filter(F.year("effective_date").isin(*years)), f"run_{run}")
    return history.read().select("sku_id", dbl("list_price").alias("list_price"), "effective_date", "end_date", "is_current")


def scd2_current(spark, sf_dir):
    """Sales valued at the current list price; sums per SKU meet one version each."""
    sold = load_star(spark, sf_dir).sales.groupBy("sku_id").agg(F.sum("quantity").alias("q"), F.sum("net_amount").alias("net"))
    current = _versions(spark, sf_dir).filter("is_current")
    return sold.join(current, "sku_id").select(
        "sku_id", dbl("list_price").alias("list_price"), big("q").alias("quantity"),
        dbl("net").alias("net_revenue"), dbl(F.col("q") * F.col("list_price")).alias("value_at_list"))


def scd2_asof_price(spark, sf_dir):
    sales = load_star(spark, sf_dir).sales.select("transaction_id", "sku_id", "transaction_date")
    return gold.price_as_of(sales, _versions(spark, sf_dir)).select(
        "transaction_id", "sku_id", "transaction_date", dbl("price_as_of").alias("price_as_of"), "effective_date")


def q_price_history(spark, sf_dir):
    """All versions of the best-selling SKU."""
    best = load_star(spark, sf_dir).sales.groupBy("sku_id").agg(F.sum("net_amount").alias("net")) \
        .orderBy(F.desc("net"), "sku_id").limit(1).select("sku_id")
    return scd2_history(spark, sf_dir).join(best, "sku_id", "left_semi").orderBy("effective_date")


# -------------------------------------------------------------------- checks

def dq_constraints(spark, sf_dir):
    s = load_star(spark, sf_dir)
    feed = canonical(spark, sf_dir)
    feed_rules = {"quantity_positive": F.col("quantity") <= 0, "unit_price_not_negative": F.col("unit_price") < 0,
                  "discount_within_total": F.col("discount_amount") > F.col("quantity") * F.col("unit_price")}
    parts = [
        gold.violations(s.sales, "sales_transactions", gold.fact_rules()),
        gold.violations(s.product, "product_master", gold.product_rules()),
        gold.violations(s.store, "store_reference", gold.store_rules()),
        gold.violations(s.calendar, "seasonal_calendar", gold.calendar_rules()),
        gold.violations(s.weather, "weather_overlay", gold.weather_rules()),
        gold.violations(feed, "canonical_feed", feed_rules),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dq_orphans(spark, sf_dir):
    """On the feed rows, before promotion filters them."""
    fact = canonical(spark, sf_dir).select(F.col("sku").alias("sku_id"), "store_id",
                                           F.col("txn_timestamp").cast("date").alias("transaction_date"))
    return gold.orphan_counts(fact, known_product(spark, sf_dir), store_dim(spark, sf_dir), calendar_dim(spark))


def dq_grain(spark, sf_dir):
    fact = gold.grain(load_star(spark, sf_dir).sales).withColumn("table_name", F.lit("sales_transactions"))
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"))
    return fact.unionByName(gold.grain(raw).withColumn("table_name", F.lit("lineitem")))


def dq_month_distribution(spark, sf_dir):
    return gold.month_distribution(load_star(spark, sf_dir).sales)


def ts_slice_key(spark, sf_dir):
    s = load_star(spark, sf_dir).sales
    return s.groupBy("category", "region_name").agg(sum_of("net_amount").alias("net_revenue")).withColumn(
        "slice_key", slice_key("category", "region_name"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    count = sql_big("COUNT(*)")
    q["dim_product"] = Query(dim_product, f"""WITH {PRODUCT_LANDING}
      SELECT CAST(l.p_partkey AS VARCHAR) AS sku_id, l.product_name, p_type AS category, p_brand AS brand,
             CAST(p_size AS VARCHAR) || ' ct' AS package_size, {sql_dbl('l.list_price')} AS list_price,
             DATE '1994-01-01' + CAST(l.p_partkey % 365 AS INTEGER) AS launch_date, 'active' AS status, TRUE AS is_current
      FROM ({LATEST_PRODUCT}) l JOIN part USING (p_partkey)""")
    q["dim_region_store_split"] = Query(dim_region_store_split, star("""
      SELECT 'region' AS kind, region_id AS id, region_name AS name, country AS attribute FROM regional_reference
      WHERE region_id IN (SELECT region_id FROM store_reference)
      UNION ALL SELECT 'store', store_id, CASE WHEN store_type = 'online' THEN store_name || ' (moved)' ELSE store_name END, store_type
      FROM store_reference"""))
    q["dim_calendar"] = Query(dim_calendar, star("""
      SELECT * FROM seasonal_calendar WHERE date BETWEEN (SELECT CAST(date_trunc('month', MIN(l_shipdate)) AS DATE) FROM lineitem)
        AND (SELECT last_day(MAX(l_shipdate)) FROM lineitem)"""))
    q["cal_season"] = Query(cal_season, star(f"""
      SELECT CAST(sc.month * 100 + day(date) AS INTEGER) AS month_day, season, {count} AS lines
      FROM lineitem JOIN seasonal_calendar sc ON CAST(l_shipdate AS DATE) = date GROUP BY ALL"""))
    q["cal_holiday"] = Query(cal_holiday, star(f"""
      SELECT date AS day, is_holiday, {count} AS lines FROM lineitem JOIN seasonal_calendar ON CAST(l_shipdate AS DATE) = date GROUP BY ALL"""))
    q["cal_month_windows"] = Query(cal_month_windows, f"""
      SELECT m AS month_start, last_day(m) AS month_end, CAST(m - INTERVAL 1 MONTH AS DATE) AS previous_month,
             CAST(m + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(m - INTERVAL 36 MONTH AS DATE) AS history_start,
             36 AS history_months, lines
      FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, {count} AS lines FROM lineitem GROUP BY 1)""")
    q["cal_fiscal_quarter"] = Query(cal_fiscal_quarter, f"""
      SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST((month(o_orderdate) + 2) // 3 AS INTEGER) AS fiscal_quarter,
             {count} AS orders FROM orders GROUP BY ALL""")
    in_data = "date BETWEEN (SELECT CAST(date_trunc('month', MIN(l_shipdate)) AS DATE) FROM lineitem) AND (SELECT last_day(MAX(l_shipdate)) FROM lineitem)"
    inserts = lambda name, where: (
        f"SELECT '{name}' AS dimension, {sql_big('COUNT(*) FILTER (year(date) < 1999)')} AS first_insert, "
        f"{sql_big('COUNT(*) FILTER (year(date) >= 1999)')} AS second_insert, {count} AS rows FROM {name} WHERE {where}")
    q["dim_insert_calendar_weather"] = Query(dim_insert_calendar_weather, star(
        inserts("seasonal_calendar", in_data) + " UNION ALL " + inserts("weather_overlay", "TRUE")))
    names = ("product_master", "regional_reference", "store_reference", "seasonal_calendar", "weather_overlay")
    q["dim_counts"] = Query(dim_counts, star(" UNION ALL ".join(f"SELECT '{n}' AS dimension, {count} AS rows FROM {n}" for n in names)))

    q["fact_measures"] = Query(fact_measures, feeds(fact_select("survivors")))
    q["fact_promote"] = Query(fact_promote, feeds(fact_select("promotable"), PROMOTABLE))
    in_months = f"CAST(date_trunc('month', l_shipdate) AS DATE) IN ({', '.join(f"DATE '{m}'" for m in ETL_MONTHS)})"
    of_months = lambda text: text.replace("FROM feed_lines\n", f"FROM feed_lines WHERE {in_months}\n")
    etl = f"""etl_fact AS ({FACT_SQL.format(rows='gold_rows')}),
etl_sales AS (
  SELECT f.*, CAST(total_amount - discount_amount AS DECIMAL(12,2)) AS net_amount, p.category, p.is_current, c.* EXCLUDE (date)
  FROM etl_fact f JOIN product_master p USING (sku_id) JOIN seasonal_calendar c ON c.date = f.transaction_date
)"""
    q["etl_category_leakage"] = Query(etl_category_leakage, of_months(feeds(f"""
      SELECT category, {sql_dbl('sum(total_amount)')} AS gross_revenue, {sql_dbl('sum(discount_amount)')} AS total_discount,
             {sql_dbl('sum(net_amount)')} AS net_revenue, {ratio('sum(discount_amount)', 'sum(total_amount)', 4)} AS discount_rate,
             {count} AS transaction_count, {sql_big('sum(quantity)')} AS total_quantity,
             {ratio('sum(net_amount)', 'count(*)', 2)} AS revenue_per_transaction
      FROM etl_sales WHERE is_current GROUP BY category""", etl)))
    q["etl_monthly_summary"] = Query(etl_monthly_summary, of_months(feeds(f"""
      SELECT year, quarter, month, season, {count} AS transaction_count, {sql_big('sum(quantity)')} AS total_quantity,
             {sql_dbl('sum(total_amount)')} AS total_revenue, {sql_dbl('sum(net_amount)')} AS net_revenue,
             {ratio('sum(net_amount)', 'count(*)', 2)} AS avg_transaction_value,
             {sql_dbl('coalesce(sum(net_amount) FILTER (is_holiday), 0)')} AS holiday_net_revenue
      FROM etl_sales GROUP BY year, quarter, month, season""", etl)))
    q["fact_idempotent"] = Query(fact_idempotent, feeds(
        f"SELECT {count} AS first_promotion, CAST(0 AS BIGINT) AS second_promotion, {count} AS fact_rows FROM promotable", PROMOTABLE))

    q["scd2_history"] = Query(scd2_history, f"WITH {HISTORY} SELECT {VERSION} FROM versions")
    q["scd2_incremental"] = Query(scd2_incremental, f"WITH {HISTORY} SELECT {VERSION} FROM versions")
    q["scd2_current"] = Query(scd2_current, star(f"""
      SELECT v.sku_id, {sql_dbl('MAX(v.list_price)')} AS list_price, {sql_big('SUM(st.quantity)')} AS quantity,
             {sql_dbl('SUM(st.net_amount)')} AS net_revenue, {sql_dbl('SUM(st.quantity * v.list_price)')} AS value_at_list
      FROM sales_transactions st JOIN versions v ON st.sku_id = v.sku_id AND v.end_date IS NULL GROUP BY v.sku_id""", HISTORY))
    q["scd2_asof_price"] = Query(scd2_asof_price, star(f"""
      SELECT st.transaction_id, st.sku_id, st.transaction_date, {sql_dbl('v.list_price')} AS price_as_of, v.effective_date
      FROM sales_transactions st JOIN versions v ON st.sku_id = v.sku_id AND st.transaction_date >= v.effective_date
        AND (v.end_date IS NULL OR st.transaction_date < v.end_date)""", HISTORY))
    q["q_price_history"] = Query(q_price_history, star(
        f"SELECT {VERSION} FROM versions WHERE sku_id = (SELECT sku_id FROM sku_net ORDER BY net DESC, sku_id LIMIT 1)", HISTORY))

    rule = lambda t, name, cond: f"SELECT '{t}' AS table_name, '{name}' AS rule, {sql_big(f'COUNT(*) FILTER ({cond})')} AS violations FROM "
    checks = [
        ("sales_transactions", "quantity_positive", "quantity <= 0"), ("sales_transactions", "unit_price_not_negative", "unit_price < 0"),
        ("sales_transactions", "total_not_negative", "total_amount < 0"), ("sales_transactions", "discount_not_negative", "discount_amount < 0"),
        ("sales_transactions", "discount_within_total", "discount_amount > total_amount"),
        ("product_master", "list_price_positive", "list_price <= 0"), ("product_master", "status_domain", "status NOT IN ('active', 'inactive')"),
        ("store_reference", "store_type_domain", "store_type NOT IN ('online', 'physical')"),
        ("seasonal_calendar", "weekday_range", "day_of_week_num NOT BETWEEN 1 AND 7"), ("seasonal_calendar", "week_range", "week_number NOT BETWEEN 1 AND 53"),
        ("seasonal_calendar", "month_range", "month NOT BETWEEN 1 AND 12"), ("seasonal_calendar", "quarter_range", "quarter NOT BETWEEN 1 AND 4"),
        ("seasonal_calendar", "season_domain", "season NOT IN ('Spring', 'Summer', 'Fall', 'Winter')"),
        ("weather_overlay", "humidity_range", "humidity NOT BETWEEN 0 AND 100"),
    ]
    feed_checks = [("quantity_positive", "quantity <= 0"), ("unit_price_not_negative", "unit_price < 0"),
                   ("discount_within_total", "discount_amount > quantity * unit_price")]
    from basketry.registry.feeds_sql import LINES
    q["dq_constraints"] = Query(dq_constraints, star(" UNION ALL ".join(
        [rule(t, n, c) + t for t, n, c in checks] + [rule("canonical_feed", n, c) + "canonical" for n, c in feed_checks]), LINES))
    missing = lambda label, cond: f"SELECT '{label}' AS dimension, {sql_big(f'COUNT(*) FILTER ({cond})')} AS orphans FROM canonical c"
    q["dq_orphans"] = Query(dq_orphans, feeds(" UNION ALL ".join([
        missing("product", "NOT EXISTS (SELECT 1 FROM known_product p WHERE p.sku_id = c.sku)"),
        missing("store", "NOT EXISTS (SELECT 1 FROM store_reference s WHERE s.store_id = c.store_id)"),
        missing("calendar", "NOT EXISTS (SELECT 1 FROM seasonal_calendar d WHERE d.date = CAST(c.txn_timestamp AS DATE))")])))
    grain = lambda name, tid, frm: f"SELECT '{name}' AS table_name, {count} AS rows, {sql_big(f'COUNT(DISTINCT {tid})')} AS distinct_ids, COUNT(*) = COUNT(DISTINCT {tid}) AS grain_ok FROM {frm}"
    q["dq_grain"] = Query(dq_grain, star(grain("sales_transactions", "transaction_id", "sales_transactions") + " UNION ALL "
                                         + grain("lineitem", "(l_orderkey || '-' || l_linenumber)", "lineitem")))
    q["dq_month_distribution"] = Query(dq_month_distribution, star(f"""
      SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month, {count} AS transactions
      FROM sales_transactions GROUP BY ALL"""))
    q["ts_slice_key"] = Query(ts_slice_key, star(f"""
      SELECT pm.category, rr.region_name, {sql_dbl('SUM(st.net_amount)')} AS net_revenue,
             regexp_replace(pm.category || '__' || rr.region_name, '[^0-9A-Za-z._-]+', '_', 'g') AS slice_key
      FROM sales_transactions st JOIN product_master pm ON st.sku_id = pm.sku_id JOIN store_reference sr ON st.store_id = sr.store_id
      JOIN regional_reference rr ON sr.region_id = rr.region_id GROUP BY ALL"""))
    return q
