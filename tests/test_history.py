"""Product history from sightings in any order, and the as-of look-up over many versions."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import gold
from basketry.operators.history import PriceHistory
from basketry.sources.versions import VersionedTable

SEEN = "sku_id string, effective_date date, list_price decimal(10,2)"
DAY = dt.date(2020, 1, 1)


def sightings(spark, seed, n=150, skus=6):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(skus)}", DAY + dt.timedelta(days=rng.randrange(40)), rng.choice([1, 2, 3])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(s, d, p) for s, d, p in rows], "sku_id string, effective_date date, list_price int").selectExpr(
        "sku_id", "effective_date", "cast(list_price as decimal(10,2)) list_price")


def shown(versions):
    return sorted(map(tuple, versions.select("sku_id", "list_price", "effective_date", "end_date", "is_current").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_history(spark, tmp_path, seed):
    rows = sightings(spark, seed)
    history = PriceHistory(spark, str(tmp_path), buckets=3)
    for run, start in enumerate(range(0, len(rows), 40)):
        history.absorb(frame(spark, rows[start:start + 40]), f"r{run}")
        assert shown(history.read()) == shown(gold.price_versions(frame(spark, rows[:start + 40])))
    before = history.versions.snapshot()
    history.absorb(frame(spark, rows[:40]), "r0")  # a run that is called again
    history.absorb(frame(spark, rows[:10]), "nothing new")
    assert history.versions.snapshot().folders == before.folders


def test_a_late_price_splits_its_interval(spark, tmp_path):
    history = PriceHistory(spark, str(tmp_path), buckets=2)
    day = lambda n: DAY + dt.timedelta(days=n)
    history.absorb(frame(spark, [("s", day(0), 1), ("s", day(20), 1), ("t", day(0), 5)]), "a")
    history.absorb(frame(spark, [("s", day(10), 2), (None, day(1), 2), ("s", None, 2), ("s", day(5), None)]), "b")
    assert sorted([(r[2], r[3]) for r in shown(history.read()) if r[0] == "s"], key=lambda v: v[0]) == [(day(0), day(10)), (day(10), day(20)), (day(20), None)]


def test_only_folders_of_touched_skus_are_rewritten(spark, tmp_path):
    history = PriceHistory(spark, str(tmp_path), buckets=16)
    history.absorb(frame(spark, [(f"s{i}", DAY, 1) for i in range(40)]), "a")
    before = history.versions.snapshot().folders
    history.absorb(frame(spark, [("s7", DAY + dt.timedelta(days=3), 2)]), "b")
    after = history.versions.snapshot().folders
    assert len(before) > 10 and sum(before[f] != after[f] for f in before) == 1


def test_a_crash_between_the_tables_is_made_good(spark, tmp_path, monkeypatch):
    history = PriceHistory(spark, str(tmp_path), buckets=2)
    rows = sightings(spark, 5, 40)
    history.absorb(frame(spark, rows[:20]), "a")
    real = VersionedTable.replace

    def lost(self, *args, **named):
        if self.path.endswith("versions"):
            raise RuntimeError("lost")
        return real(self, *args, **named)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "replace", lost)
        with pytest.raises(RuntimeError):
            history.absorb(frame(spark, rows[20:]), "b")
    history.absorb(frame(spark, rows[20:]), "b")
    assert shown(history.read()) == shown(gold.price_versions(frame(spark, rows)))


def test_as_of_over_ten_thousand_versions_of_a_hot_sku(spark):
    """Every sale meets one version, also without any broadcast."""
    days = spark.range(10_000).select(F.lit("HOT").alias("sku_id"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("effective_date"),
                                      (F.col("id") % 7).cast("decimal(10,2)").alias("list_price"))
    versions = gold.price_versions(days.unionByName(spark.sql(f"select 'COLD' sku_id, date'{DAY}' effective_date, cast(1 as decimal(10,2)) list_price")))
    assert versions.count() == 10_001
    n = 200_000
    fact = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 100)).otherwise("HOT").alias("sku_id"),
                                 F.date_add(F.lit(DAY), F.when(F.col("id") % 10 < 8, 5).otherwise(F.col("id") % 10_000).cast("int")).alias("transaction_date"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = gold.price_as_of(fact.repartition(8), versions).select("id", "price_as_of", "transaction_date").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == len({r.id for r in rows}) == n * 9 // 10
    assert all(int(r.price_as_of) == (r.transaction_date - DAY).days % 7 for r in rows)


def test_as_of_leaves_gaps_and_days_before_out(spark):
    versions = spark.createDataFrame(
        [("s", 1, dt.date(2020, 1, 1), dt.date(2020, 1, 5)), ("s", 2, dt.date(2020, 1, 8), None)], "sku_id string, list_price int, effective_date date, end_date date")
    fact = spark.createDataFrame([(i, "s", dt.date(2020, 1, i)) for i in range(1, 11)] + [(0, "s", dt.date(2019, 12, 31)), (11, None, DAY), (12, "s", None)],
                                 "id int, sku_id string, transaction_date date")
    got = {r.id: r.price_as_of for r in gold.price_as_of(fact, versions).collect()}
    assert got == {**{i: 1 for i in range(1, 5)}, **{i: 2 for i in range(8, 11)}}
