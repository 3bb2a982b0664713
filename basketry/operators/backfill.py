"""All months in one job: what the monthly loop, oldest month first, would leave behind.

Every row gets its outcome once, in one written frame; the clean layer, quarantine, audit, fact and run
log are cut from it.  The contest of a key works on order columns alone: one narrow row per
key and month, so neither the payload nor all copies of a key are ever sorted or gathered.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from basketry.operators import gold, silver as S
from basketry.operators.latest import latest_per_key
from basketry.operators.silver import KEY, NEWEST, ROW, Lake
from basketry.session import discard, spool


@dataclass(frozen=True)
class Backfill:
    """``outcomes``: every row with its outcome, a dropped one with the row that was kept; ``months``: one row per key and month."""

    outcomes: DataFrame
    months: DataFrame
    now: dt.datetime

    def silver(self) -> DataFrame:
        """The clean layer after the last month: each key's newest row."""
        return S.as_silver(self.outcomes.filter("outcome = 'loaded' and is_last"))

    def rejected(self) -> DataFrame:
        """Quarantined rows with their reasons."""
        return self.outcomes.filter("outcome = 'rejected'").withColumn("rejected_at", F.lit(self.now))

    def audit(self) -> DataFrame:
        """Dropped copies: those of a month that lost its contest, and stored rows that a later month replaced."""
        dropped = lambda rows, gone: rows.select(
            "batch_month", *KEY, F.col("kept.batch_id").alias("kept_batch_id"), F.col(f"{gone}batch_id").alias("dropped_batch_id"),
            F.col("kept.ingested_at").alias("kept_ingested_at"), F.col(f"{gone}ingested_at").alias("dropped_ingested_at"),
            F.lit(self.now).alias("deduped_at"))
        replaced = self.months.filter("loaded and stored is not null").withColumn("kept", F.col("best"))
        return dropped(self.outcomes.filter("outcome = 'deduped'"), "").unionByName(dropped(replaced, "stored."))

    def gold_rows(self, promotable: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The row of each key that reached the fact: its first loaded, promotable version."""
        loaded = promotable(self.outcomes.filter("outcome = 'loaded'"))
        return latest_per_key(loaded, KEY, [F.col("batch_month").asc()])

    def runs(self, gold_rows: DataFrame | None = None) -> DataFrame:
        """Run counts per month, as the monthly loop would log them."""
        o = F.col("outcome")
        out = self.outcomes.groupBy("batch_month").agg(
            F.count("*").alias("rows_in"), *[F.count_if(o == x).alias(f"rows_{x}") for x in ("loaded", "rejected", "deduped")])
        if gold_rows is not None:
            promoted = gold_rows.groupBy("batch_month").agg(F.count("*").alias("rows_promoted"))
            out = out.join(promoted, "batch_month", "left").na.fill(0, ["rows_promoted"])
        return S.with_status(out)


def backfill(rows: DataFrame, product: DataFrame, now: dt.datetime) -> Backfill:
    """Judge adapted rows with their ``batch_month``.

    A month's winner is loaded unless an earlier month had one as new; ``stored`` is the newest row before the
    month, ``kept`` the one after it.  A row meets its month with the winner's row number and what the audit names, nothing
    else of the contest travels or is written twice.
    """
    prepared = S.prepare(rows, product, None, now)
    valid = prepared.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    order = F.struct(*NEWEST, ROW)
    best = valid.groupBy(*KEY, "batch_month").agg(F.max(order).alias("best"))
    of_key = Window.partitionBy(*KEY)
    earlier = of_key.orderBy("batch_month").rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in NEWEST])
    months = best.withColumns({"stored": F.max("best").over(earlier), "is_newest": F.col("best") == F.max("best").over(of_key)})
    loaded = F.col("stored").isNull() | (newest("best") > newest("stored"))
    months = spool(months.withColumn("loaded", loaded), "backfill-months")
    named = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ("batch_id", "ingested_at")])
    contest = months.select(*KEY, "batch_month", "loaded", "is_newest", F.col(f"best.{ROW}").alias("_best"),
                            F.when(F.col("loaded"), named("best")).otherwise(named("stored")).alias("_kept"))
    first = F.col(ROW) == F.col("_best")
    wins = F.col("loaded") & first
    judged = valid.join(contest, [*KEY, "batch_month"]).withColumns({
        "outcome": F.when(wins, "loaded").otherwise("deduped"), "is_last": F.col("is_newest") & first,
        "kept": F.when(~wins, F.col("_kept"))}).drop("_best", "_kept", "is_newest", "loaded")
    rejected = prepared.filter(F.col("reject_reason").isNotNull()).withColumn("outcome", F.lit("rejected"))
    outcomes = spool(judged.unionByName(rejected, allowMissingColumns=True), "backfill")
    discard(prepared)
    return Backfill(outcomes, months, now)


def write_backfill(spark: SparkSession, lake: Lake, done: Backfill, product: DataFrame, store: DataFrame, calendar: DataFrame) -> DataFrame:
    """Write every layer of an empty lake; the run log.  Written again, it leaves the same."""
    run_id = F.concat(F.lit("run_"), F.date_format("batch_month", "yyyyMM"))
    gold_rows = spool(done.gold_rows(lambda d: gold.promotable(d, product, store, calendar)), "backfill-gold")
    runs = done.runs(gold_rows).select(
        run_id.alias("run_id"), F.col("batch_month").alias("target_month"), F.lit(done.now).alias("started_at"),
        F.current_timestamp().alias("completed_at"), "rows_in", "rows_loaded", "rows_rejected", "rows_deduped", "status")
    for rows, path, columns in ((done.rejected(), lake.rejected, S.QUARANTINE_COLUMNS), (done.audit(), lake.audit, S.AUDIT_COLUMNS)):
        (rows.select(*columns, run_id.alias("run_id")).hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(path))
    runs.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(lake.runs)
    S.table(spark, lake).upsert(done.silver(), "backfill")
    facts = gold.fact_rows(gold_rows).withColumn("sale_year", F.year("transaction_date"))
    gold.fact_table(spark, lake).insert_absent(facts, "backfill")
    return S.read_runs(spark, lake)
