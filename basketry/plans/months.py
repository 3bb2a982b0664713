"""The monthly job as one call, and the reports' star over what it has written."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import gold, silver as S
from basketry.operators.adapter import Spec, adapt_all
from basketry.operators.silver import Lake
from basketry.sources import bronze
from basketry.sources.star import Star, enriched_sales


def build_dims(product_landing: DataFrame, place_landing: DataFrame, lake: Lake) -> dict[str, int]:
    """Write the product, region and store dimension of a lake from landed references; rows of each."""
    region, store = gold.split_region_store(place_landing)
    out = {}
    for name, rows in (("product", gold.product_from_landing(product_landing)), ("region", region), ("store", store)):
        path = lake.path("gold", name)
        rows.write.mode("overwrite").parquet(path)
        out[name] = rows.sparkSession.read.parquet(path).count()
    return out


def run_month(spark: SparkSession, lake: Lake, feeds: dict[str, DataFrame], month: dt.date, product: DataFrame, store: DataFrame,
              calendar: DataFrame, now: dt.datetime, specs: dict[str, Spec] | None = None) -> dict:
    """Land each native feed of the month, adapt, clean and promote; the run's counts.

    A feed is landed under ``<source>_<yyyymm>`` and read back from its own folder, so what is
    cleaned is what was landed.  Called again, after a crash at any step or none, it
    leaves what one call leaves and returns the same counts.
    """
    landed = {}
    for source, rows in feeds.items():
        batch = f"{source}_{month:%Y%m}"
        landed[source] = bronze.land_once(rows, lake.path("bronze", source), source, f"{batch}.csv", batch, now)
    run_id = f"run_{month:%Y%m}"
    run, loaded = S.take_batch(spark, lake, adapt_all(landed, specs=specs), product, month, run_id, now)
    return {**run, "rows_promoted": gold.promote(spark, lake, loaded, product, store, calendar, tag=run_id)}


def star_from_lake(spark: SparkSession, lake: Lake, product: DataFrame, store: DataFrame, region: DataFrame,
                   calendar: DataFrame, weather: DataFrame) -> Star:
    """The star over the fact that promotion has written; all views and reports take it."""
    fact = gold.fact_table(spark, lake).read().drop("sale_year")
    return Star(enriched_sales(fact, product, store, region), product, store, region, calendar, weather)
