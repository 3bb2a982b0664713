"""The monthly job as one call, dimension build, and reports over what it leaves."""
import datetime as dt
import shutil

import pytest
from conftest import MONTH, NOW
from pyspark.sql import functions as F

from basketry.operators import gold, silver as S
from basketry.operators.silver import Lake
from basketry.plans import months, views
from basketry.sources import bronze
from basketry.sources.feeds import FEED_SCHEMAS
from basketry.sources.versions import VersionedTable


def test_two_months_from_landing_to_report(spark, lake, dims):
    product, store, calendar = dims
    feed = lambda rows: {"pos_system_b": spark.createDataFrame(rows, FEED_SCHEMAS["pos_system_b"])}
    row = lambda i, day, sku, cents: (f"B-{i}", f"{day} 08:15:00", sku, 2, cents, 0, "STORE-PHYS")
    first = months.run_month(spark, lake, feed([row(1, "2026-02-10", "SKU-A", 100), row(2, "2026-02-11", "SKU-Z", 100)]),
                             dt.date(2026, 2, 1), *dims, NOW)
    second = months.run_month(spark, lake, feed([row(3, "2026-03-10", "SKU-B", 250), row(4, "2026-03-11", "SKU-A", -1), row(1, "2026-02-10", "SKU-A", 300)]),
                              MONTH, *dims, NOW + dt.timedelta(hours=1))
    assert (first["rows_in"], first["rows_loaded"], first["rows_promoted"], first["run_id"]) == (2, 2, 1, "run_202602")
    assert (second["rows_in"], second["rows_loaded"], second["rows_rejected"], second["rows_promoted"]) == (3, 2, 1, 1)
    assert spark.read.parquet(lake.path("bronze", "pos_system_b")).groupBy("batch_id").count().count() == 2
    region = spark.createDataFrame([("REGION-T", "North", "X")], "region_id string, region_name string, country string")
    star = months.star_from_lake(spark, lake, product.withColumn("is_current", F.lit(True)), store, region, calendar, calendar.limit(0))
    got = views.category_leakage(star).first()
    assert (got.category, got.transaction_count, got.gross_revenue) == ("Electronics", 2, 7.0)


def test_dimensions_are_written_and_counted(spark, lake):
    product = spark.createDataFrame(
        [("s1", "old", 1), ("s1", "new", 2), ("s2", "only", 1)], "sku string, product_name string, ingested_at int").selectExpr(
        "*", "'c' category", "'b' brand", "'1 ct' package_size", "1.0 list_price", "'2020-01-01' launch_date", "'active' status")
    places = spark.createDataFrame(
        [("r1", "R", "X", "st1", "One", "physical", 1), ("r1", "R", "X", "st2", "Two", "online", 1)],
        "region_id string, region_name string, country string, store_id string, store_name string, store_type string, ingested_at int")
    assert months.build_dims(product, places, lake) == {"product": 2, "region": 1, "store": 2}
    assert {r.product_name for r in spark.read.parquet(lake.path("gold", "product")).collect()} == {"new", "only"}


FEBRUARY = dt.date(2026, 2, 1)


def sale(i, day, sku, cents):
    return (f"B-{i}", f"{day} 08:15:00", sku, 2, cents, 0, "STORE-PHYS")


FIRST = [sale(1, "2026-02-10", "SKU-A", 100), sale(2, "2026-02-11", "SKU-B", 100), sale(2, "2026-02-11", "SKU-B", 100)]
SECOND = [sale(3, "2026-03-10", "SKU-B", 250), sale(4, "2026-03-11", "SKU-A", -1), sale(1, "2026-02-10", "SKU-A", 300),
          sale(2, "2026-02-11", "SKU-A", 700), sale(2, "2026-02-11", "SKU-A", 800)]


def march(spark, lake, dims):
    rows = spark.createDataFrame(SECOND, FEED_SCHEMAS["pos_system_b"]).coalesce(1)
    return months.run_month(spark, lake, {"pos_system_b": rows}, MONTH, *dims, NOW + dt.timedelta(hours=1))


def february(spark, lake, dims):
    rows = spark.createDataFrame(FIRST, FEED_SCHEMAS["pos_system_b"]).coalesce(1)
    return months.run_month(spark, lake, {"pos_system_b": rows}, FEBRUARY, *dims, NOW)


def state(spark, lake):
    """Everything a lake holds, but for the clock time at which a run ended."""
    parts = [S.table(spark, lake).read(), gold.fact_table(spark, lake).read(), S.read_runs(spark, lake).drop("completed_at"),
             *[spark.read.parquet(p) for p in (lake.rejected, lake.audit, lake.path("bronze", "pos_system_b"))]]
    return [sorted(map(repr, p.select(sorted(p.columns)).collect())) for p in parts]


@pytest.fixture(scope="module")
def once(spark, dims, tmp_path_factory):
    lake = Lake(str(tmp_path_factory.mktemp("once")))
    return february(spark, lake, dims), march(spark, lake, dims), state(spark, lake)


def test_exact_ties_keep_one_copy(spark, once):
    first, second, (silver, fact, *_) = once
    assert (first["rows_in"], first["rows_loaded"], first["rows_deduped"], first["rows_promoted"], first["status"]) == (3, 2, 1, 2, "ok")
    assert (second["rows_in"], second["rows_loaded"], second["rows_rejected"], second["rows_deduped"], second["status"]) == (5, 3, 1, 1, "ok")
    assert len(silver) == 3 and len(fact) == 3 and sum("unit_price=8.0" in r for r in silver) == 1


def test_months_again_change_nothing(spark, dims, tmp_path, once):
    lake = Lake(str(tmp_path))
    runs = [dict(f(spark, lake, dims), completed_at=None) for f in (february, february, march, march, february)]
    assert runs[0] == runs[1] == runs[4] and runs[2] == runs[3] == dict(once[1], completed_at=None)
    assert state(spark, lake) == once[2]


@pytest.fixture(scope="module")
def after_february(spark, dims, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("february") / "lake")
    february(spark, Lake(root), dims)
    return root


STEPS = [(bronze, "create_once", False), (bronze, "create_once", True), (S, "audit_rows", True), (VersionedTable, "_write", True),
         (VersionedTable, "_commit", True), (S, "outcome_counts", False), (gold, "promote", False), (VersionedTable, "insert_absent", True)]


@pytest.mark.parametrize("place, step, after", STEPS, ids=[f"{'after' if a else 'before'}-{s}" for _, s, a in STEPS])
def test_a_crash_at_any_step_is_made_good(spark, dims, tmp_path, monkeypatch, once, after_february, place, step, after):
    lake, real = Lake(str(tmp_path / "lake")), getattr(place, step)
    shutil.copytree(after_february, lake.root)

    def lost(*args, **named):
        if after:
            real(*args, **named)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(place, step, lost)
        with pytest.raises(RuntimeError, match="lost"):
            march(spark, lake, dims)
    march(spark, lake, dims)
    assert state(spark, lake) == once[2]


def test_sequence_numbers_order_all_landings(spark, tmp_path):
    path = str(tmp_path / "landed")
    for n, batch in enumerate(("b2", "b1", "b3")):
        rows = spark.range(100 * n, 100 * n + 100).repartition(7)
        assert bronze.land_once(rows, path, "s", "f", batch, NOW).count() == 100
    assert bronze.land_once(spark.range(5), path, "s", "f", "b1", NOW).count() == 100
    landed = spark.read.parquet(path)
    seen = {r.batch_id: (r.low, r.high, r.n) for r in landed.groupBy("batch_id").agg(
        F.min("ingest_seq").alias("low"), F.max("ingest_seq").alias("high"), F.count_distinct("ingest_seq").alias("n")).collect()}
    assert all(high - low == 99 and n == 100 for low, high, n in seen.values())
    assert seen["b2"] < seen["b1"] < seen["b3"]
    assert bronze.land_once(spark.range(0), path, "s", "f", "empty", NOW).count() == 0
