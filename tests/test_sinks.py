"""Landing and writes."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.sources import bronze, sinks
from basketry.functions.text import row_hash

AT = dt.datetime(2026, 3, 1, 6, 0)


def test_landing_appends_counts_and_keeps_batches_apart(spark, tmp_path):
    path = str(tmp_path / "bronze")
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    assert bronze.land(rows, path, "s", "f.csv", "b1", AT) == 100
    assert bronze.land(rows.limit(0), path, "s", "f.csv", "b0", AT) == 0
    assert bronze.land(rows, path, "s", "f.csv", "b1", AT) == 100
    assert bronze.land(rows.filter("id < 7"), path, "s", "g.csv", "b2", AT) == 7
    assert spark.read.parquet(path).count() == 207
    one = bronze.read_batch(spark, path, "b2")
    assert one.count() == 7 and one.select("ingest_seq").distinct().count() == 7
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan


def test_row_hash_ignores_column_order_and_reads_null_as_empty(spark):
    a = spark.createDataFrame([("x", None)], "p string, q int")
    b = spark.createDataFrame([(None, "x")], "q int, p string")
    assert a.select(row_hash(a)).first() == b.select(row_hash(b)).first()
    c = spark.createDataFrame([("x", 0)], "p string, q int")
    assert c.select(row_hash(c)).first() != a.select(row_hash(a)).first()


@pytest.fixture(params=["default", "no broadcast"])
def join_style(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "no broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_insert_absent_is_idempotent(spark, tmp_path, join_style):
    path = str(tmp_path / "t")
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit("first").alias("v"))
    assert sinks.insert_absent(spark, rows.filter("k < '5'"), path, ["k"]) == 5
    assert sinks.insert_absent(spark, rows.withColumn("v", F.lit("second")), path, ["k"]) == 5
    assert sinks.insert_absent(spark, rows, path, ["k"]) == 0
    got = dict(spark.read.parquet(path).collect())
    assert len(got) == 10 and got["0"] == "first" and got["9"] == "second"


def test_latest_dim(spark):
    rows = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new"), ("t", 1, "only")], "k string, ingested_at int, v string")
    assert sorted(bronze.latest_dim(rows, ["k"]).select("k", "v").collect()) == [("s", "new"), ("t", "only")]


def test_csv_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5)], "x string, y double")
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "c")).collect() == df.collect()


def test_unknown_format_is_refused(spark):
    from basketry.sources.feeds import read_feed

    with pytest.raises(ValueError):
        read_feed(spark, "pos_system_a", "x", "xml")


def test_an_unreadable_count_is_not_taken_for_nothing(spark, tmp_path):
    from py4j.protocol import Py4JJavaError

    class Lost:
        @property
        def get(self):
            raise Py4JJavaError("", spark._jvm.java.lang.RuntimeException("lost"))

    with pytest.raises(Exception):
        sinks._rows_written(Lost(), spark.range(3))
    assert sinks._rows_written(Lost(), spark.range(0)) == 0
