"""Quarantine, flags, dedup, reconciliation, promotion, and the one-job backfill."""
import datetime as dt
import random

import pytest
from conftest import MONTH, NOW
from pyspark.sql import functions as F

from basketry.operators import backfill, gold, silver as S

T9 = dt.datetime(2026, 3, 10, 9, 0, 0)
SEC = dt.timedelta(seconds=1)


def run(spark, lake, dims, rows, run_id="run_test", month=MONTH):
    return S.process_batch(spark, lake, rows, dims[0], month, run_id, NOW)


def silver(spark, lake):
    return S.table(spark, lake).read()


def random_batch(rng, size):
    """Rows over few keys, so that most are re-sends, with every kind of fault now and then."""
    return [{
        "source_txn_id": f"K{rng.randrange(size // 4)}", "batch_id": f"b{rng.randrange(3)}", "ingested_at": T9 + rng.randrange(4) * SEC,
        "quantity": rng.choice([1.0, 2.0, 5.0, 0.0, None]), "unit_price": rng.choice([0.0, 3.5, 8.0, -2.0, None]),
        "store_id": rng.choice(["STORE-PHYS", "STORE-ONL", "STORE-X", None]), "sku": rng.choice(["SKU-A", "SKU-B", "SKU-Z"]),
        "txn_timestamp": rng.choice([dt.datetime(2026, 3, 4, 5), dt.datetime(2026, 2, 1), None]), "ingest_seq": i,
    } for i in range(size)]


def faults(row):
    found = {f"{c}:not_nullable" for c in ("quantity", "unit_price", "store_id", "txn_timestamp") if row[c] is None}
    if row["quantity"] is not None and row["quantity"] <= 0:
        found.add("quantity:quantity_not_positive")
    if row["unit_price"] is not None and row["unit_price"] < 0:
        found.add("unit_price:unit_price_negative")
    return found


@pytest.mark.parametrize("seed", [3, 4])
def test_random_batches_keep_the_rules(spark, lake, dims, canonical, seed):
    """Every landed row is loaded, rejected or deduped; the newest valid one of a key wins, over all batches so far."""
    rng = random.Random(seed)
    best, rejected, dropped = {}, [], 0
    order = lambda r: (r["ingested_at"], r["batch_id"], r["ingest_seq"])
    for number in range(2):
        batch = random_batch(rng, 60)
        for i, r in enumerate(batch):
            r["ingest_seq"] = 1000 * number + i
        valid = [r for r in batch if not faults(r)]
        rejected += [r for r in batch if faults(r)]
        before = dict(best)
        for r in valid:
            if r["source_txn_id"] not in best or order(r) > order(best[r["source_txn_id"]]):
                best[r["source_txn_id"]] = r
        loaded = sum(before.get(k) is not r for k, r in best.items())
        replaced = sum(k in before and before[k] is not r for k, r in best.items())
        dropped += len(valid) - loaded + replaced
        m = run(spark, lake, dims, canonical(batch), f"run{number}")
        assert (m["rows_in"], m["rows_loaded"], m["rows_rejected"], m["rows_deduped"]) == (
            60, loaded, 60 - len(valid), len(valid) - loaded) and m["status"] == "ok"
    assert {r.source_txn_id: r.ingest_seq for r in silver(spark, lake).collect()} == {k: r["ingest_seq"] for k, r in best.items()}
    reasons = sorted("; ".join(sorted(r.reject_reason.split("; "))) for r in spark.read.parquet(lake.rejected).collect())
    assert reasons == sorted("; ".join(sorted(faults(r))) for r in rejected)
    assert spark.read.parquet(lake.audit).count() == dropped
    log = S.read_runs(spark, lake).collect()
    assert len(log) == 2 and all(r.rows_in == r.rows_loaded + r.rows_rejected + r.rows_deduped for r in log)


def test_all_failures_of_a_row_are_named(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([
        {"quantity": 0.0, "unit_price": -1.0, "discount_amount": -2.0, "txn_timestamp": NOW + dt.timedelta(days=2), "sku": None}]))
    assert spark.read.parquet(lake.rejected).first().reject_reason == (
        "txn_timestamp:txn_timestamp_in_future; sku:not_nullable; quantity:quantity_not_positive; "
        "unit_price:unit_price_negative; discount_amount:discount_negative")


def test_orphans_and_late_rows_are_kept_and_flagged(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([
        {"source_txn_id": "known"}, {"source_txn_id": "orphan", "sku": "SKU-ORPHAN"},
        {"source_txn_id": "late", "txn_timestamp": dt.datetime(2026, 2, 14, 10, 0)},
        {"source_txn_id": "early", "txn_timestamp": dt.datetime(2026, 4, 1, 1, 0)}]))
    got = {r.source_txn_id: (r.sku_unmatched, r.late_arrival) for r in silver(spark, lake).collect()}
    assert got == {"known": (False, False), "orphan": (True, False), "late": (False, True), "early": (False, False)}


def test_ties_go_to_larger_batch_then_later_arrival(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([
        {"source_txn_id": "b", "batch_id": "b2", "unit_price": 2.0}, {"source_txn_id": "b", "batch_id": "b1", "unit_price": 1.0},
        {"source_txn_id": "s", "unit_price": 3.0}, {"source_txn_id": "s", "unit_price": 4.0}]))
    assert dict(silver(spark, lake).select("source_txn_id", "unit_price").collect()) == {"b": 2.0, "s": 4.0}


def test_resend_across_batches_replaces_even_in_another_month(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([
        {"source_txn_id": "X", "batch_id": "b1", "unit_price": 5.0, "ingested_at": T9, "txn_timestamp": dt.datetime(2026, 2, 3)},
        {"source_txn_id": "Y", "batch_id": "b1", "ingested_at": T9}]), "r1")
    m = run(spark, lake, dims, canonical([{"source_txn_id": "X", "batch_id": "b2", "unit_price": 7.0, "ingested_at": T9 + SEC}]), "r2")
    rows = {r.source_txn_id: (r.batch_id, r.unit_price, r.txn_month) for r in silver(spark, lake).collect()}
    assert rows == {"X": ("b2", 7.0, "2026-03"), "Y": ("b1", 10.0, "2026-03")}
    assert (m["rows_in"], m["rows_loaded"], m["rows_deduped"], m["status"]) == (1, 1, 0, "ok")
    assert spark.read.parquet(lake.audit).select("kept_batch_id", "dropped_batch_id").collect() == [("b2", "b1")]


def test_older_resend_loses_to_the_stored_row(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([{"source_txn_id": "X", "batch_id": "b2", "ingested_at": T9 + SEC, "unit_price": 7.0}]), "r1")
    m = run(spark, lake, dims, canonical([{"source_txn_id": "X", "batch_id": "b1", "ingested_at": T9, "unit_price": 5.0}]), "r2")
    assert (m["rows_loaded"], m["rows_deduped"], m["status"]) == (0, 1, "ok")
    assert silver(spark, lake).select("unit_price").collect() == [(7.0,)]


def test_imbalance_is_a_warning(spark):
    df = spark.createDataFrame([(5, 1, 1, 1)], "rows_in long, rows_loaded long, rows_rejected long, rows_deduped long")
    assert S.with_status(df).first().status == "reconciliation_warning"


def test_promotion_measures_grain_and_idempotence(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([
        {"source_txn_id": "g1", "quantity": 2.0, "unit_price": 10.0, "discount_amount": 1.0},
        {"source_txn_id": "g2", "sku": "SKU-B", "store_id": "STORE-ONL", "quantity": 3.0, "unit_price": 4.0},
        {"source_txn_id": "orphan", "sku": "SKU-ORPHAN"}, {"source_txn_id": "nowhere", "store_id": "STORE-X"},
        {"source_txn_id": "undated", "txn_timestamp": dt.datetime(2026, 1, 5)}]))
    assert gold.promote(spark, lake, silver(spark, lake), *dims) == 2
    fact = gold.fact_table(spark, lake).read()
    assert gold.grain(fact).first() == (2, 2, True)
    g1 = fact.filter("transaction_id = 'pos_system_a-g1'").first()
    assert (g1.quantity, float(g1.total_amount), float(g1.net_amount)) == (2, 20.0, 19.0)
    assert gold.promote(spark, lake, silver(spark, lake), *dims) == 0
    assert gold.fact_table(spark, lake).read().count() == 2
    assert sorted(r.orphans for r in gold.orphan_counts(fact, *dims).collect()) == [0, 0, 0]


def test_corrections_reach_the_fact_only_on_upsert(spark, lake, dims, canonical):
    run(spark, lake, dims, canonical([{"source_txn_id": "X", "unit_price": 5.0, "ingested_at": T9}]), "r1")
    gold.promote(spark, lake, silver(spark, lake), *dims)
    run(spark, lake, dims, canonical([{"source_txn_id": "X", "unit_price": 6.0, "ingested_at": T9 + SEC}]), "r2")
    price = lambda: [float(r.unit_price) for r in gold.fact_table(spark, lake).read().collect()]
    assert gold.promote(spark, lake, silver(spark, lake), *dims) == 0 and price() == [5.0]
    assert gold.promote(spark, lake, silver(spark, lake), *dims, mode="upsert") == 0 and price() == [6.0]


def test_backfill_in_one_job_equals_the_monthly_loop(spark, lake, dims, canonical):
    """Random re-sends across months; one key holds a third of all rows."""
    rng = random.Random(7)
    months = [dt.date(2026, 1, 1), dt.date(2026, 2, 1), dt.date(2026, 3, 1)]
    rows, batch_month = [], []
    for i in range(240):
        month = rng.choice(months)
        key = "HOT" if i % 3 == 0 else f"K{rng.randrange(40)}"
        rows.append({
            "source_txn_id": key, "batch_id": f"a_{month:%Y%m}",
            "ingested_at": dt.datetime(month.year, month.month, rng.randrange(1, 28)),
            "txn_timestamp": dt.datetime(2026, rng.choice([1, 2, 3]), rng.randrange(1, 28)),
            "sku": rng.choice(["SKU-A", "SKU-B", "SKU-ORPHAN"]), "quantity": float(rng.choice([1, 2, 3, -1])),
            "unit_price": float(rng.randrange(1, 50)), "ingest_seq": i})
        batch_month.append(month)
    everything = canonical(rows).withColumn("batch_month", F.trunc("ingested_at", "MM"))

    logged = {}
    for month in months:
        m = run(spark, lake, dims, everything.filter(F.col("batch_month") == F.lit(month)), f"r{month}", month)
        promoted = gold.promote(spark, lake, silver(spark, lake), *dims)
        logged[month] = (m["rows_in"], m["rows_loaded"], m["rows_rejected"], m["rows_deduped"], promoted)

    state = backfill.backfill(everything, dims[0], NOW)
    gold_rows = state.gold_rows(lambda d: gold.promotable(d, *dims))
    runs = state.runs(gold_rows).collect()
    assert {r.batch_month: (r.rows_in, r.rows_loaded, r.rows_rejected, r.rows_deduped, r.rows_promoted) for r in runs} == logged
    assert {r.status for r in runs} == {"ok"}
    cols = ["source_txn_id", "batch_id", "ingested_at", "unit_price", "quantity", "sku_unmatched", "late_arrival"]
    assert sorted(state.silver().select(cols).collect()) == sorted(silver(spark, lake).select(cols).collect())
    fact = ["transaction_id", "sku_id", "quantity", "unit_price", "transaction_date"]
    assert sorted(gold.fact_rows(gold_rows).select(fact).collect()) == sorted(gold.fact_table(spark, lake).read().select(fact).collect())
    one = S.Lake(lake.root + "-one")
    for _ in range(2):  # a second call leaves the same
        log = {r.target_month: (r.rows_in, r.rows_loaded, r.rows_rejected, r.rows_deduped) for r in backfill.write_backfill(spark, one, state, *dims).collect()}
        assert log == {m: n[:4] for m, n in logged.items()}
        assert sorted(silver(spark, one).select(cols).collect()) == sorted(silver(spark, lake).select(cols).collect())
        assert sorted(gold.fact_table(spark, one).read().select(fact).collect()) == sorted(gold.fact_table(spark, lake).read().select(fact).collect())
        for path, columns in ((lambda x: x.audit, S.AUDIT_COLUMNS), (lambda x: x.rejected, S.REJECTED_COLUMNS)):
            read = lambda x: sorted(map(repr, spark.read.parquet(path(x)).select(columns).collect()))  # noqa: E731, B023
            assert read(one) == read(lake) and len(read(one)) > 20
