"""What a job leaves on disk: tables that no later step reads are gone, and what stays is small."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import backfill as B, silver as S
from basketry.session import discard, path_exists, scratch_root, spool
from basketry.sources.feeds import SOURCES, landed_feed, passing_feed
from basketry.sources.star import session_folder
from basketry.sources.versions import names_in
from conftest import MONTH, NOW

T = dt.datetime(2026, 3, 10, 12, 0)


def tables(spark, label):
    return {n for n in names_in(spark, scratch_root(spark)) if n.startswith(f"{label}-")}


@pytest.fixture()
def lines(spark, tmp_path):
    """Order lines with every defect of the feeds; one line comes twice."""
    rows = [(k, n, k % 7 + 1, k % 5 + 1, float(n + k % 3), 100.0 + k, 0.05, dt.datetime(1998, 1 + k % 12, 3)) for k in range(80, 104) for n in (1, 2)]
    out = spark.createDataFrame(
        [*rows, rows[0]], "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_shipdate timestamp")
    out.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    return str(tmp_path / "sf")


def test_a_feed_read_in_passing_is_the_landed_one(spark, lines):
    text = lambda rows: sorted(map(str, rows.collect()))
    passing = {s: passing_feed(spark, lines, s) for s in SOURCES}
    got = {s: text(rows) for s, rows in passing.items()}
    assert not path_exists(spark, f"{session_folder(spark, lines)}/bronze")  # nothing was written for it
    assert got == {s: text(landed_feed(spark, lines, s).select(*passing[s].columns)) for s in SOURCES}
    assert "bronze" in passing_feed(spark, lines, SOURCES[0]).inputFiles()[0]  # once landed, the landed table is read


def test_written_intermediates_are_packed(spark):
    kept = spool(spark.range(10), "packed")
    assert all(".zstd." in f for f in kept.inputFiles())
    discard(kept)


def test_writes_leave_no_staging_behind(spark, dims, lake, canonical):
    """A batch into the clean layer: its prepared rows and its updates are deleted, its counts and tables stay."""
    labels = ("prepared", "updates", "inserts")
    before = {label: tables(spark, label) for label in labels}
    rows = canonical([{}, {"source_txn_id": "T-0000", "ingested_at": T + dt.timedelta(seconds=1)}, {"quantity": -1.0}])
    run, loaded = S.take_batch(spark, lake, rows, dims[0], MONTH, "r", NOW)
    fact = S.VersionedTable(spark, f"{lake.root}/other", S.SILVER_SCHEMA, S.KEY, S.PARTITION)
    assert fact.insert_absent(loaded) == loaded.count() == run["rows_loaded"] == 1
    assert {label: tables(spark, label) for label in labels} == before
    assert S.table(spark, lake).read().count() == 1 and spark.read.parquet(lake.audit).count() == 1


def test_backfill_writes_the_contest_once(spark, dims, canonical):
    """The prepared rows are deleted, only dropped rows name the one that was kept, and the audit is whole."""
    before = tables(spark, "prepared")
    later = dt.datetime(2026, 4, 2)
    rows = canonical([
        {"source_txn_id": "A"}, {"source_txn_id": "A", "batch_id": "batch_2", "ingested_at": T + dt.timedelta(hours=1)},
        {"source_txn_id": "A", "batch_id": "batch_3", "ingested_at": later}, {"source_txn_id": "B"},
        {"source_txn_id": "C", "batch_id": "batch_4", "ingested_at": later}, {"source_txn_id": "C"},
    ]).withColumn("batch_month", F.trunc("ingested_at", "MM"))
    done = B.backfill(rows, dims[0], NOW + dt.timedelta(days=30))
    assert tables(spark, "prepared") == before
    assert done.outcomes.filter("outcome = 'loaded' and kept is not null").isEmpty()
    assert done.outcomes.filter("outcome = 'deduped' and kept is null").isEmpty()
    assert not {"last", "kept"} & set(done.months.columns)
    audit = done.audit().select("source_txn_id", "kept_batch_id", "dropped_batch_id").collect()
    assert sorted(map(tuple, audit)) == [("A", "batch_2", "batch_1"), ("A", "batch_3", "batch_2"), ("C", "batch_4", "batch_1")]
    assert sorted((r.source_txn_id, r.batch_id) for r in done.silver().collect()) == [("A", "batch_3"), ("B", "batch_1"), ("C", "batch_4")]
