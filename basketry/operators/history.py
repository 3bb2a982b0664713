"""Product history kept up to date: sightings arrive in any order, late ones among them.

Versions cannot be merged from versions alone: a late price splits the interval it falls into, and when the
old price came back is known only from the sightings after it.  So one row per SKU and day is kept, and
the versions of the SKUs that gained or changed a day are cut anew from theirs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketry.operators.gold import price_versions
from basketry.session import spool
from basketry.sources.versions import Snapshot, VersionedTable, value_of

BUCKET = "bucket"
SIGHTINGS = T.StructType([
    T.StructField("sku_id", T.StringType()),
    T.StructField("effective_date", T.DateType()),
    T.StructField("list_price", T.DecimalType(10, 2)),
    T.StructField(BUCKET, T.IntegerType()),
])
VERSIONS = T.StructType([
    T.StructField("sku_id", T.StringType()),
    T.StructField("list_price", T.DecimalType(10, 2)),
    T.StructField("effective_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("is_current", T.BooleanType()),
    T.StructField(BUCKET, T.IntegerType()),
])


class PriceHistory:
    """Sightings and versions under one root, in folders by a hash of the SKU."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.buckets = buckets
        self.sightings = VersionedTable(spark, f"{root}/sightings", SIGHTINGS, ["sku_id", "effective_date"], BUCKET)
        self.versions = VersionedTable(spark, f"{root}/versions", VERSIONS, ["sku_id"], BUCKET)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64("sku_id"), F.lit(self.buckets)).cast("int"))

    def absorb(self, seen: DataFrame, run_id: str) -> Snapshot:
        """Take sightings (sku_id, effective_date, list_price) in; the commit of the versions.

        Of several prices of a day the highest counts, whichever run brought it.  Rows without SKU, day or price
        take no part.  A run that is called again leaves what one call leaves.
        """
        base = self.sightings.before(run_id)
        seen = seen.filter("sku_id is not null and effective_date is not null and list_price is not null")
        daily = spool(seen.groupBy("sku_id", "effective_date").agg(F.max(F.col("list_price").cast("decimal(10,2)")).alias("list_price")), "sightings")
        known = self.sightings.holding(daily, base).select("sku_id", "effective_date", F.col("list_price").alias("_known"))
        news = daily.join(known, ["sku_id", "effective_date"], "left").filter("_known is null or list_price > _known").drop("_known")
        news = spool(self._bucketed(news), "news")
        after = self.sightings.upsert(news, run_id, base)
        touched = news.select("sku_id", BUCKET).distinct()
        buckets = {str(r[0]) for r in touched.select(BUCKET).distinct().collect()}
        days = self.sightings.read(after, [f for f in after.folders if value_of(f) in buckets]).join(touched, ["sku_id", BUCKET], "left_semi")
        return self.versions.replace(spool(self._bucketed(price_versions(days)), "versions"), touched, run_id)

    def read(self) -> DataFrame:
        """All versions."""
        return self.versions.read().drop(BUCKET)
