"""Plan shape and hot keys: what keeps the jobs alive on large, skewed data."""
import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from basketry.operators import gold, silver as S
from basketry.plans import catalogue as C, features as X, forecast as T, views
from basketry.registry.all import all_queries
from basketry.registry import models, warehouse
from basketry.session import SMALL_TASKS, discard, path_exists, small_tasks, spool
from basketry.sources import feeds, star as star_module
from basketry.sources.star import load_star, sales_fact

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF)


def test_duplicates_are_cut_before_the_shuffle(spark):
    text = plan(sales_fact(spark, SF))
    below_exchange = text[text.index("Exchange hashpartitioning(l_orderkey"):]
    assert "row_number(), 1, Partial" in below_exchange


def test_reports_read_few_columns_and_prune_years(star):
    text = plan(C.category_quarter(star, 2000, 4))
    assert re.search(r"PartitionFilters: \[.*sale_year.*2000", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",") if ":" in c} <= {"category", "is_current", "net_amount", "transaction_date"}


def test_reports_aggregate_the_fact_before_any_join(star):
    for view in (views.daily_sales_summary, views.sales_by_product, views.monthly_sales_summary, views.sales_weather_context):
        text = plan(view(star))
        first_join = re.search(r"\w+Join", text).start()
        assert "HashAggregate" in text[first_join:text.index("FileScan parquet", first_join)]


def test_monthly_sample_is_limited_before_the_shuffle(star):
    assert "row_number(), 100, Partial" in plan(X.history_sample(star, dt.date(2001, 10, 20)))


def test_top_products_need_no_full_sort(star):
    assert "TakeOrderedAndProject" in plan(C.products_by_revenue(star))


def test_no_registered_query_plans_a_cross_join(spark):
    for name in ("v_sku_revenue_pareto", "rep_concentration_scenario", "rep_category_features", "ts_slice_series",
                 "backfill", "dedup_audit", "flag_sku_unmatched", "feat_decay_weight"):
        text = plan(all_queries()[name].build(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_large_dimensions_are_joined_without_broadcast(spark, star):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(views.sales_by_product(star))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_hot_key_rows_are_split_over_tasks(spark, canonical):
    """A third of the rows share one key; with small targets AQE must split its join."""
    n = 30_000
    base = canonical([{}]).drop("source_txn_id", "ingest_seq", "ingested_at")
    wide = spark.range(n).withColumns({
        "source_txn_id": F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.col("id").cast("string"))),
        "ingested_at": F.timestamp_seconds(1_770_000_000 + F.col("id")), "ingest_seq": F.col("id")})
    row = base.first().asDict()
    rows = wide.select("*", *[F.lit(row[c]).cast(base.schema[c].dataType).alias(c) for c in base.columns]).drop("id")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        tagged = S.tag_copies(rows.repartition(8))
        audit = S.audit_rows(tagged, dt.datetime(2026, 3, 31))
        assert audit.count() == n // 3 - 1
        assert audit.select("kept_ingested_at").distinct().count() == 1
        out = tagged.filter("not is_kept")
        out.collect()
        assert "skewed" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_prices_seen_very_often_stay_one_row_per_day(spark):
    seen = spark.range(20_000).select(F.lit("HOT").alias("sku_id"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 10).cast("int")).alias("effective_date"),
                                      ((F.col("id") % 10) / 5).cast("int").alias("list_price"))
    versions = gold.price_versions(seen)
    assert versions.count() == 2
    text = plan(versions)
    window = text.index("Window")
    assert "HashAggregate" in text[window:]


def test_feed_lines_are_sorted_before_their_text_is_made(spark):
    """What the sort of a landing holds is numbers, not the text columns made from them."""
    rows = feeds.audited_feed(spark, SF, "pos_system_b", every_line=True, by_month=True)
    below_sort = plan(rows)[plan(rows).index("Sort ["):]
    assert "sha2(" in plan(rows) and "sha2(" not in below_sort and "concat_ws(" not in below_sort
    months = rows.select("batch_month", F.spark_partition_id().alias("p")).collect()
    for p in {r["p"] for r in months}:
        mine = [r["batch_month"] for r in months if r["p"] == p]
        assert mine == sorted(mine)


def test_large_sorted_writes_run_in_small_tasks(spark, tmp_path, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    with pytest.raises(ValueError), small_tasks(spark):
        assert all(spark.conf.get(k) == v for k, v in SMALL_TASKS.items())
        raise ValueError
    assert {k: spark.conf.get(k, None) for k in SMALL_TASKS} == before
    entered = []
    monkeypatch.setattr(star_module, "small_tasks", lambda s: entered.append(s) or small_tasks(s))
    sales = load_star(spark, SF).sales
    star_module.write_sales(sales, str(tmp_path / "sales"))
    assert entered and spark.read.parquet(str(tmp_path / "sales")).count() == sales.count()


def test_monthly_reports_do_not_build_the_whole_fact(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("the session's fact was built")

    monkeypatch.setattr(warehouse, "load_star", unwanted)
    assert warehouse.etl_monthly_summary(spark, SF).count() >= len(warehouse.ETL_MONTHS)  # late sales belong to earlier months


@pytest.fixture()
def unwritten(tmp_path, monkeypatch):
    """The small tables under a folder whose fact nobody has written; writing it fails."""
    def refused(*_):
        raise AssertionError("the fact was written")

    (tmp_path / "sf").symlink_to(SF)
    monkeypatch.setattr(star_module, "write_sales", refused)
    return str(tmp_path / "sf")


def test_total_forecast_reads_the_sales_once_without_writing_the_fact(spark, star, unwritten):
    rows = models.rep_forecast(spark, unwritten).collect()
    assert rows and rows == T.aggregate_forecast(star, models.AS_OF, 3).collect()


def test_slice_forecasts_read_the_sales_once_without_writing_the_fact(spark, star, unwritten, monkeypatch):
    monkeypatch.setattr(T, "order_grid", lambda arrays: arrays)
    found = models._fits(spark, unwritten)[1].select("slice_id", "y", "last")
    expected = T.series_arrays(T.with_slice_id(T.slice_series(star, models.AS_OF))).select("slice_id", "y", "last")
    assert sorted(found.collect()) == sorted(expected.collect())


def test_small_tasks_stay_small_in_a_session_of_few_partitions(spark, monkeypatch):
    """AQE only merges shuffle partitions, so there must be more of them than the session has."""
    monkeypatch.setitem(SMALL_TASKS, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        with small_tasks(spark):
            rows = spool(spark.range(100_000).groupBy("id").agg(F.count("*").alias("n")), "many")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows.inputFiles()) > 2 and rows.count() == 100_000


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.splitlines() if "/shuffle_" in f}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spool(spark.range(100_000).repartition(4, "id").groupBy("id").count(), "step")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert rows.count() == 100_000


def test_discarded_steps_are_deleted(spark):
    rows = spool(spark.range(10), "step")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, folder)
    discard(rows)
    assert not path_exists(spark, folder)
