"""Streams reach the batch result, in several micro-batches and after a restart."""
import datetime as dt
import random

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from basketry.operators import silver as S
from basketry.sources.feeds import FEED_SCHEMAS
from basketry.streaming import streams


def feed_file(spark, path, rows, batch, at):
    df = spark.createDataFrame(rows, FEED_SCHEMAS["pos_system_b"]).withColumns({
        "source_system": F.lit("pos_system_b"), "batch_id": F.lit(batch), "ingested_at": F.lit(at),
        "ingest_seq": F.monotonically_increasing_id(), "batch_month": F.lit(dt.date(2026, 3, 1))})
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_chain_stream_takes_files_batch_by_batch(spark, dims, tmp_path):
    path, lake, ck = str(tmp_path / "in"), S.Lake(str(tmp_path / "lake")), str(tmp_path / "ck")
    row = lambda i, cents: (f"B-{i}", "2026-03-10 08:15:00", "SKU-B", 2, cents, 0, "STORE-PHYS")
    at = dt.datetime(2026, 3, 11)
    schema = feed_file(spark, path, [row(1, 100), row(2, 200), row(3, -5)], "b1", at)

    def run():
        stream = streams.file_stream(spark, path, schema, max_files=1)
        streams.chain_stream({"pos_system_b": stream}, lake, ck, *dims, NOW, "stream")

    run()
    feed_file(spark, path, [row(2, 999), row(4, 400)], "b2", at + dt.timedelta(days=1))
    run()
    run()  # nothing new
    silver = S.table(spark, lake).read()
    assert dict(silver.select("source_txn_id", "unit_price").collect()) == {"B-1": 1.0, "B-2": 9.99, "B-4": 4.0}
    runs = {r.run_id: (r.rows_in, r.rows_loaded, r.rows_rejected, r.rows_deduped) for r in S.read_runs(spark, lake).collect()}
    assert runs == {"stream_0": (3, 2, 1, 0), "stream_1": (2, 2, 0, 0)}
    fact = dict(streams.gold.fact_table(spark, lake).read().select("transaction_id", F.col("unit_price").cast("double")).collect())
    assert fact == {"pos_system_b-B-1": 1.0, "pos_system_b-B-2": 2.0, "pos_system_b-B-4": 4.0}


def test_landing_stream_lands_each_file_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.range(1).schema
    for n in (3, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        streams.land_stream(streams.file_stream(spark, source, schema), out, str(tmp_path / "ck"), "s", "b")
    got = spark.read.parquet(out)
    assert got.count() == 7 and {"source_system", "source_file", "batch_id", "ingested_at", "row_hash", "ingest_seq"} <= set(got.columns)
    per_batch = got.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("ingest_seq").alias("d")).orderBy("n").collect()
    assert [(r.n, r.d) for r in per_batch] == [(3, 3), (4, 4)]


def pos_b(i, cents):
    return (f"B-{i}", "2026-03-10 08:15:00", "SKU-B", 2, cents, 0, "STORE-PHYS")


def chain(spark, path, schema, lake, checkpoint, dims, name):
    streams.chain_stream({"pos_system_b": streams.file_stream(spark, path, schema)}, lake, checkpoint, *dims, NOW, name)


def test_two_streams_into_one_lake(spark, dims, tmp_path):
    lake = S.Lake(str(tmp_path / "lake"))
    for n in (1, 2):
        path = str(tmp_path / f"in{n}")
        schema = feed_file(spark, path, [pos_b(n, 100 * n)], f"b{n}", dt.datetime(2026, 3, 11))
        chain(spark, path, schema, lake, str(tmp_path / f"ck{n}"), dims, f"stream{n}")
    assert S.table(spark, lake).read().count() == 2 and streams.gold.fact_table(spark, lake).read().count() == 2
    assert {r.run_id for r in S.read_runs(spark, lake).collect()} == {"stream1_0", "stream2_0"}


@pytest.mark.parametrize("step", ["silver", "log", "promote"])
def test_crash_at_a_step_is_made_good(spark, dims, tmp_path, monkeypatch, step):
    path, lake, ck = str(tmp_path / "in"), S.Lake(str(tmp_path / "lake")), str(tmp_path / "ck")
    schema = feed_file(spark, path, [pos_b(1, 100), pos_b(2, 200), pos_b(2, 200), pos_b(3, -5)], "b1", dt.datetime(2026, 3, 11))
    target = {"silver": (S.VersionedTable, "upsert"), "log": (S, "outcome_counts"), "promote": (streams.gold, "promote")}[step]

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*target, fail)
        with pytest.raises(Exception):
            chain(spark, path, schema, lake, ck, dims, "s")
    chain(spark, path, schema, lake, ck, dims, "s")
    count = lambda p: spark.read.parquet(p).count()
    assert (S.table(spark, lake).read().count(), streams.gold.fact_table(spark, lake).read().count()) == (2, 2)
    assert (count(lake.rejected), count(lake.audit), count(lake.runs)) == (1, 1, 1)


LATEST = "k string, at timestamp, batch string, seq bigint, v double, part int"


def latest_case(spark, tmp_path, rows_by_file, delay):
    path = str(tmp_path / "in")
    target = S.VersionedTable(spark, str(tmp_path / "out"), spark.createDataFrame([], LATEST).schema, ["k"], "part")
    for n, rows in enumerate(rows_by_file):
        spark.createDataFrame(rows, LATEST).coalesce(1).write.mode("append").parquet(path)
        stream = streams.file_stream(spark, path, target.schema, max_files=1)
        streams.keep_latest(stream, target, ["at", "batch", "seq"], str(tmp_path / "ck"), "s", delay)
    return target


def test_latest_wins_equals_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    at = lambda n: dt.datetime(2026, 3, 1) + dt.timedelta(microseconds=n)
    rows = [(k, at(rng.randrange(40)), rng.choice(["a", "b", None]), 1 - (1 << 62) + i, rng.choice([None, float(i)]), 0)
            for i in range(200) for k in [rng.choice(["hot", "hot", "x", "y y", "", None, "\u00e9"])]]
    files = [rows[i::4] for i in range(4)]
    got = latest_case(spark, tmp_path, files, "1 day").read().collect()
    none_first = lambda r: (r[1], r[2] is not None, r[2] or "", r[3])
    want = {}
    for r in rows:
        if r[0] not in want or none_first(r) > none_first(want[r[0]]):
            want[r[0]] = r
    assert {r.k: tuple(r) for r in got if r.k is not None} == {k: r for k, r in want.items() if k is not None}


def test_latest_wins_sends_corrections_and_forgets(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 3, 1) + dt.timedelta(hours=h)
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = spark.createDataFrame([], LATEST).schema
    files = [[("a", at(1), "x", 1, 1.0, 0)], [("a", at(2), "x", 1, 2.0, 0), ("a", at(0), "x", 9, 9.0, 0)], [("a", at(1), "x", 1, 1.0, 0)],
             [("z", at(99), "x", 1, 5.0, 0)], [("a", at(3), "x", 1, 3.0, 0)], [("a", at(98.5), "x", 1, 4.0, 0)]]
    for rows in files:  # the fifth comes later than the delay allows
        spark.createDataFrame(rows, LATEST).coalesce(1).write.mode("append").parquet(path)
        stream = streams.latest_wins(streams.file_stream(spark, path, schema, max_files=1), ["k"], ["at", "batch", "seq"], "2 hours")
        streams.write_stream(stream, out, ck)
    got = sorted((r.k, r.v, r.is_correction) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1.0, False), ("a", 2.0, True), ("a", 4.0, False), ("z", 5.0, False)]


def test_a_stream_is_not_ordered_by_a_double(spark, tmp_path):
    with pytest.raises(TypeError, match="cannot order"):
        spark.createDataFrame([("a", dt.datetime(2026, 3, 1), "x", 1, 1.0, 0)], LATEST).write.parquet(str(tmp_path / "in"))
        streams.latest_wins(streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LATEST).schema), ["k"], ["at", "v"])
