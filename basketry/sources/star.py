"""The sales star, built over the order tables and written once per session.

The fact is deduplicated, joined to the product, store and region keys' attributes
once, and written as Parquet split by sale year with each file holding few months.
Reports then scan a narrow set of columns and aggregate without shuffling the fact.
"""
from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass, replace
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.functions import dates as D
from basketry.functions.money import MONEY, rounded
from basketry.operators.latest import latest_per_key
from basketry.session import configure, little_disk, path_exists, scratch_root, small_tasks

CALENDAR_START = dt.date(1995, 1, 1)
CALENDAR_END = dt.date(2001, 12, 31)

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]


@dataclass(frozen=True)
class Star:
    """The star tables; ``sales`` carries product, store and region attributes."""

    sales: DataFrame
    product: DataFrame
    store: DataFrame
    region: DataFrame
    calendar: DataFrame
    weather: DataFrame

    def where(self, condition: Column) -> Star:
        """The same star over some of its sales."""
        return replace(self, sales=self.sales.filter(condition))

    def register(self, spark: SparkSession, prefix: str = "") -> None:
        names = {
            "sales_transactions": self.sales, "product_master": self.product,
            "store_reference": self.store, "regional_reference": self.region,
            "seasonal_calendar": self.calendar, "weather_overlay": self.weather,
        }
        for name, df in names.items():
            df.createOrReplaceTempView(prefix + name)


# Per session: schemas of files already opened, and stars already built.
_schemas: WeakKeyDictionary = WeakKeyDictionary()
_stars: WeakKeyDictionary = WeakKeyDictionary()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; the footers are opened for the schema only the first time."""
    known = _schemas.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- dimensions

def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.concat(F.col("p_size").cast("string"), F.lit(" ct")).alias("package_size"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"),
        F.date_add(F.lit("1994-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("launch_date"),
        F.when(F.col("p_size") > 45, "inactive").otherwise("active").alias("status"),
        (F.col("p_partkey") % 11 != 0).alias("is_current"),
    )


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("country"))
    return (
        table(spark, sf_dir, "region")
        .join(country, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("r_regionkey").cast("string").alias("region_id"),
            F.col("r_name").alias("region_name"),
            "country",
        )
    )


def store_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.col("n_regionkey").cast("string").alias("region_id"),
            F.when(F.col("s_suppkey") % 3 == 0, "online").otherwise("physical").alias("store_type"),
        )
    )


def marketing_event(d: Column | str) -> Column:
    slot = F.dayofyear(D.col(d)) % 13
    return F.when(slot == 0, "Flash Sale").when(slot == 5, "Clearance").when(slot == 9, "Loyalty Week")


def calendar_columns(days: DataFrame) -> DataFrame:
    """Calendar attributes of a one-column frame of dates."""
    return days.select(
        "date",
        F.date_format("date", "EEEE").alias("day_of_week"),
        (F.weekday("date") + 1).alias("day_of_week_num"),
        F.weekofyear("date").alias("week_number"),
        F.month("date").alias("month"),
        F.quarter("date").alias("quarter"),
        F.year("date").alias("year"),
        D.is_holiday("date").alias("is_holiday"),
        D.season("date").alias("season"),
        marketing_event("date").alias("marketing_event"),
    )


def calendar_dim(spark: SparkSession, start: dt.date = CALENDAR_START, end: dt.date = CALENDAR_END) -> DataFrame:
    """One row per day of the inclusive window."""
    spine = spark.range(1, numPartitions=1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date")
    )
    return calendar_columns(spine)


def calendar_over(df: DataFrame, day: str) -> DataFrame:
    """Calendar of every day in the months that ``day`` covers."""
    bounds = df.agg(F.trunc(F.min(day), "MM").alias("lo"), F.last_day(F.max(day)).alias("hi"))
    return calendar_columns(bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")))


def weather_dim(spark: SparkSession, sf_dir: str, start: dt.date = CALENDAR_START,
                end: dt.date = CALENDAR_END) -> DataFrame:
    """Weather per region and day; some days are missing on purpose."""
    key, doy, yr = F.col("r_regionkey"), F.dayofyear("date"), F.year("date")
    cond = (doy * 7 + key * 3 + yr) % 10
    temp = ((doy * 11 + key * 17 + yr * 3) % 450).cast("decimal(10,2)") / F.lit(10).cast("decimal(10,2)") - 5
    rain = ((doy * 5 + key * 7) % 200).cast("decimal(10,2)") / F.lit(10).cast("decimal(10,2)")
    return (
        table(spark, sf_dir, "region")
        .select("r_regionkey", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date"))
        .filter((doy + key) % 29 != 0)
        .select(
            F.col("r_regionkey").cast("string").alias("region_id"),
            "date",
            temp.cast("decimal(5,2)").alias("temperature_avg"),
            (temp - 4).cast("decimal(5,2)").alias("temperature_min"),
            (temp + 5).cast("decimal(5,2)").alias("temperature_max"),
            F.when(cond < 4, 0).otherwise(rain).cast("decimal(8,2)").alias("precipitation"),
            ((doy * 3 + key) % 101).cast("int").alias("humidity"),
            F.when(cond < 4, "Sunny").when(cond < 7, "Rainy").when(cond < 9, "Cloudy")
            .otherwise("Stormy").alias("weather_condition"),
            F.when(cond == 9, "Storm Warning").alias("weather_alert"),
        )
    )


# ---------------------------------------------------------------------- fact

def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = sorted({*LINE_KEY, *LINE_ORDER})
    lines = table(spark, sf_dir, "lineitem").select(*cols)
    return latest_per_key(lines, LINE_KEY, [F.col(c).desc() for c in LINE_ORDER])


def sale_amounts(lines: DataFrame) -> DataFrame:
    """Line columns as transaction measures, in decimal."""
    total = F.col("l_extendedprice").cast(MONEY)
    rate = F.col("l_discount").cast("decimal(4,2)")
    return lines.withColumns({
        "total_amount": total,
        "discount_amount": F.round(total * rate, 2).cast("decimal(10,2)"),
        "quantity": F.col("l_quantity").cast("int"),
    }).withColumns({
        "net_amount": (F.col("total_amount") - F.col("discount_amount")).cast(MONEY),
        "unit_price": rounded(F.try_divide(F.col("total_amount").cast("double"),
                                           F.col("quantity").cast("double")), 2).cast("decimal(10,2)"),
    })


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_amounts(unique_lines(spark, sf_dir)).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        "quantity", "unit_price", "total_amount", "discount_amount", "net_amount",
    )


def enriched_sales(fact: DataFrame, product: DataFrame, store: DataFrame, region: DataFrame) -> DataFrame:
    """Fact with the report attributes of its product, store and region.

    No side is forced to broadcast: Spark broadcasts a dimension under the session's
    size threshold and sort-merge joins it beyond, where AQE splits hot keys.
    """
    return (
        fact
        .join(product.select("sku_id", "category", "brand", "list_price", "is_current"), "sku_id")
        .join(store.select("store_id", "store_type", "region_id")
              .join(region.select("region_id", "region_name", "country"), "region_id"), "store_id")
        .withColumn("sale_year", F.year("transaction_date"))
    )


def write_sales(sales: DataFrame, path: str) -> None:
    """Directories by year, files by month; AQE splits a month that is too large."""
    laid_out = (
        sales.withColumn("_m", F.month("transaction_date"))
        .hint("rebalance", "sale_year", "_m")
        .sortWithinPartitions("sale_year", "transaction_date")
        .drop("_m")
    )
    with small_tasks(sales.sparkSession), little_disk(sales.sparkSession):
        laid_out.write.mode("overwrite").partitionBy("sale_year").parquet(path)


def session_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the tables derived from ``sf_dir`` in this session."""
    return f"{scratch_root(spark)}/derived-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"


def sales_star(spark: SparkSession, sf_dir: str) -> Star:
    """Star for a job that aggregates the sales in one pass: the written fact where there is one, else not written at all.

    Unwritten, the fact is neither laid out by month nor copied, and only the columns the job reads outlive
    the removal of copies.  Build its jobs within ``small_tasks``, as the written fact is.
    """
    if path_exists(spark, f"{session_folder(spark, sf_dir)}/sales/_SUCCESS"):
        return load_star(spark, sf_dir)
    configure(spark)
    product, store, region = product_dim(spark, sf_dir), store_dim(spark, sf_dir), region_dim(spark, sf_dir)
    return Star(
        sales=enriched_sales(sales_fact(spark, sf_dir), product, store, region),
        product=product, store=store, region=region,
        calendar=calendar_dim(spark), weather=weather_dim(spark, sf_dir),
    )


def load_star(spark: SparkSession, sf_dir: str) -> Star:
    """Star over ``sf_dir``; the fact is written on first use and read afterwards."""
    configure(spark)
    built = _stars.setdefault(spark, {})
    path = f"{session_folder(spark, sf_dir)}/sales"
    written = path_exists(spark, f"{path}/_SUCCESS")
    if sf_dir in built and written:
        return built[sf_dir]
    product, store, region = product_dim(spark, sf_dir), store_dim(spark, sf_dir), region_dim(spark, sf_dir)
    if not written:
        write_sales(enriched_sales(sales_fact(spark, sf_dir), product, store, region), path)
    built[sf_dir] = Star(
        sales=spark.read.parquet(path),
        product=product, store=store, region=region,
        calendar=calendar_dim(spark), weather=weather_dim(spark, sf_dir),
    )
    return built[sf_dir]
