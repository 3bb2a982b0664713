"""Dimensions, fact promotion, product history and integrity checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from basketry.functions.money import big
from basketry.operators.silver import Lake
from basketry.sources.bronze import latest_dim
from basketry.sources.versions import VersionedTable


# ---------------------------------------------------------------- dimensions

def product_from_landing(landed: DataFrame) -> DataFrame:
    return latest_dim(landed, ["sku"]).select(
        F.col("sku").alias("sku_id"), "product_name", "category", "brand", "package_size", "list_price",
        F.col("launch_date").cast("date").alias("launch_date"), "status", F.lit(True).alias("is_current"),
    )


def split_region_store(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One combined reference gives the region and the store dimension, each by its own key."""
    region = latest_dim(landed, ["region_id"], ["ingested_at", "store_id"]).select("region_id", "region_name", "country")
    store = latest_dim(landed, ["store_id"]).select("store_id", "store_name", "region_id", "store_type")
    return region, store


def dim_counts(dims: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in dims.items():
        one = df.agg(F.lit(name).alias("dimension"), big(F.count(F.lit(1))).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------------- fact

def fact_rows(silver: DataFrame) -> DataFrame:
    """Clean rows as fact rows; amounts are decimal from here on."""
    money = lambda c: F.round(c.cast("decimal(24,8)"), 2)
    total = F.round(F.col("quantity") * F.col("unit_price").cast("decimal(18,6)"), 2).cast("decimal(12,2)")
    out = silver.select(
        F.concat_ws("-", "source_system", "source_txn_id").alias("transaction_id"),
        F.col("sku").alias("sku_id"),
        "store_id",
        F.col("txn_timestamp").cast("date").alias("transaction_date"),
        F.col("txn_timestamp").alias("transaction_time"),
        F.col("quantity").cast("int").alias("quantity"),
        money(F.col("unit_price")).cast("decimal(10,2)").alias("unit_price"),
        total.alias("total_amount"),
        money(F.col("discount_amount")).cast("decimal(10,2)").alias("discount_amount"),
    )
    return out.withColumn("net_amount", (F.col("total_amount") - F.col("discount_amount")).cast("decimal(12,2)"))


def promotable(silver: DataFrame, product: DataFrame, store: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows whose SKU matched and whose product, store and date exist."""
    return (
        silver.filter(~F.col("sku_unmatched"))
        .withColumn("_day", F.col("txn_timestamp").cast("date"))
        .join(calendar.select(F.col("date").alias("_day")), "_day", "left_semi")
        .join(store.select("store_id"), "store_id", "left_semi")
        .join(product.select(F.col("sku_id").alias("sku")), "sku", "left_semi")
        .drop("_day")
    )


FACT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("transaction_date", T.DateType()),
    T.StructField("transaction_time", T.TimestampType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(10, 2)),
    T.StructField("total_amount", T.DecimalType(12, 2)),
    T.StructField("discount_amount", T.DecimalType(10, 2)),
    T.StructField("net_amount", T.DecimalType(12, 2)),
    T.StructField("sale_year", T.IntegerType()),
])


def fact_table(spark: SparkSession, lake: Lake) -> VersionedTable:
    """The fact: one row per transaction, in folders by year."""
    return VersionedTable(spark, lake.fact, FACT_SCHEMA, ["transaction_id"], "sale_year")


def promote(spark: SparkSession, lake: Lake, silver: DataFrame, product: DataFrame, store: DataFrame,
            calendar: DataFrame, mode: str = "insert", tag: str | None = None) -> int:
    """Add promotable rows to the fact and return how many are new.

    ``silver`` may be the whole clean layer or, after a run, just that run's rows; the
    whole is needed once when a dimension has gained rows.
    ``insert`` never changes a fact row, so a later correction stays in the clean layer;
    ``upsert`` lets the correction through.  With a ``tag`` (a run's id) a second call adds nothing and gives the first one's count.
    """
    rows = fact_rows(promotable(silver, product, store, calendar)).withColumn("sale_year", F.year("transaction_date"))
    fact = fact_table(spark, lake)
    if mode == "insert":
        return fact.insert_absent(rows, tag)
    if mode == "upsert":
        before = fact.read().count()
        return fact.read(fact.upsert(rows, tag)).count() - before
    raise ValueError(f"unknown mode: {mode}")


# ------------------------------------------------------------ product history

def price_versions(observations: DataFrame) -> DataFrame:
    """Version rows (effective_date, end_date, is_current) where the price changed.

    Sightings shrink to one per SKU and day before the window, so a product seen very
    often still has at most one row per day in it.
    """
    daily = observations.groupBy("sku_id", "effective_date").agg(F.max("list_price").alias("list_price"))
    w = Window.partitionBy("sku_id").orderBy("effective_date")
    before = F.lag("list_price").over(w)
    changed = daily.withColumn("_prev", before).filter(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("list_price"))).drop("_prev")
    end = F.lead("effective_date").over(w)
    return changed.withColumn("end_date", end).withColumn("is_current", F.col("end_date").isNull())


def price_as_of(fact: DataFrame, versions: DataFrame, day: str = "transaction_date") -> DataFrame:
    """The version in force on each row's day; rows before the first version, or in a gap, drop out.

    Rows shrink to their distinct SKUs and days, which are merged with the versions by day and carry the last one on:
    one pass in the order of time, whether a SKU has one version or ten thousand, over at most one row
    per day of the calendar.  Rows then meet their day's version by equality, where a hot SKU can be split.
    """
    none = F.lit(None).cast("date")
    asked = fact.select("sku_id", F.col(day).alias("_day")).distinct().select(
        "sku_id", "_day", F.lit(1).alias("_asks"), F.lit(None).cast(versions.schema["list_price"].dataType).alias("price_as_of"),
        none.alias("effective_date"), none.alias("end_date"))
    known = versions.select(
        "sku_id", F.col("effective_date").alias("_day"), F.lit(0).alias("_asks"), F.col("list_price").alias("price_as_of"), "effective_date", "end_date")
    in_order = Window.partitionBy("sku_id").orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(F.col("_asks") == 0, F.struct("price_as_of", "effective_date", "end_date")), ignorenulls=True).over(in_order)
    found = asked.unionByName(known).withColumn("_version", carried).filter("_asks = 1 and _version is not null").select(
        F.col("sku_id").alias("_sku"), "_day", "_version.*")
    found = found.filter("end_date is null or _day < end_date")
    return fact.join(found, (F.col("sku_id") == F.col("_sku")) & (F.col(day) == F.col("_day"))).drop("_sku", "_day")


# -------------------------------------------------------------------- checks

def violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, one line per rule, from one pass over the table."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.select(F.lit(table).alias("table_name"),
                         F.expr(f"stack({len(rules)}, {pairs}) as (rule, violations)"))


def fact_rules() -> dict[str, Column]:
    c = F.col
    return {
        "quantity_positive": c("quantity") <= 0,
        "unit_price_not_negative": c("unit_price") < 0,
        "total_not_negative": c("total_amount") < 0,
        "discount_not_negative": c("discount_amount") < 0,
        "discount_within_total": c("discount_amount") > c("total_amount"),
    }


def product_rules() -> dict[str, Column]:
    return {
        "list_price_positive": F.col("list_price") <= 0,
        "status_domain": ~F.col("status").isin("active", "inactive"),
    }


def store_rules() -> dict[str, Column]:
    return {"store_type_domain": ~F.col("store_type").isin("online", "physical")}


def calendar_rules() -> dict[str, Column]:
    c = F.col
    return {
        "weekday_range": ~c("day_of_week_num").between(1, 7),
        "week_range": ~c("week_number").between(1, 53),
        "month_range": ~c("month").between(1, 12),
        "quarter_range": ~c("quarter").between(1, 4),
        "season_domain": ~c("season").isin("Spring", "Summer", "Fall", "Winter"),
    }


def weather_rules() -> dict[str, Column]:
    return {"humidity_range": ~F.col("humidity").between(0, 100)}


def orphan_counts(fact: DataFrame, product: DataFrame, store: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fact rows without a product, store or date.

    The fact is counted per key before it meets a dimension, so a hot key is one row.
    """
    def missing(key: str, dim: DataFrame, dim_key: str, label: str) -> DataFrame:
        per_key = fact.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        gone = per_key.join(dim.select(F.col(dim_key).alias("_k")), "_k", "left_anti")
        return gone.agg(F.lit(label).alias("dimension"), big(F.coalesce(F.sum("n"), F.lit(0))).alias("orphans"))

    return (
        missing("sku_id", product, "sku_id", "product")
        .unionByName(missing("store_id", store, "store_id", "store"))
        .unionByName(missing("transaction_date", calendar, "date", "calendar"))
    )


def grain(fact: DataFrame) -> DataFrame:
    """Row count against distinct transaction ids, from one count per id."""
    per_id = fact.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        big(F.coalesce(F.sum("n"), F.lit(0))).alias("rows"), big(F.count(F.lit(1))).alias("distinct_ids"),
    ).withColumn("grain_ok", F.col("rows") == F.col("distinct_ids"))


def month_distribution(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy(F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month"))
        .agg(big(F.count(F.lit(1))).alias("transactions")).orderBy("year", "month")
    )
