"""Canonical rows to the clean layer: validate, flag, deduplicate, merge, reconcile.

A re-sent transaction may repeat without bound, so no step gathers all copies of a key
in one task.  The newest copy is found by an aggregate that combines before the
shuffle, and copies meet their winner in a join whose hot keys AQE can split.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketry.functions.dates import month_start
from basketry.operators import quality
from basketry.operators.adapter import CANONICAL, RAW
from basketry.operators.latest import latest_per_key
from basketry.session import discard, little_disk, spool
from basketry.sources.sinks import replace_run
from basketry.sources.versions import VersionedTable

KEY = ["source_system", "source_txn_id"]
NEWEST = ["ingested_at", "batch_id", "ingest_seq"]
ARRIVAL = "arrival"  # stored copies arrived before those of the current batch
ROW = "row_number"  # written down with the rows of a batch, so that it is the same in every reader
FLAGS = ["sku_unmatched", "late_arrival"]
PARTITION = "txn_month"

SILVER_SCHEMA = T.StructType([
    T.StructField("source_system", T.StringType()),
    T.StructField("source_txn_id", T.StringType()),
    T.StructField("txn_timestamp", T.TimestampType()),
    T.StructField("sku", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("discount_amount", T.DoubleType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("sku_unmatched", T.BooleanType()),
    T.StructField("late_arrival", T.BooleanType()),
    T.StructField("ingest_seq", T.LongType()),
    T.StructField(PARTITION, T.StringType()),
])
REJECTED_COLUMNS = [*CANONICAL, "reject_reason", "rejected_at"]
QUARANTINE_COLUMNS = [*REJECTED_COLUMNS, *RAW]
AUDIT_COLUMNS = [*KEY, "kept_batch_id", "dropped_batch_id", "kept_ingested_at", "dropped_ingested_at", "deduped_at"]
RUN_SCHEMA = (
    "run_id string, target_month date, started_at timestamp, completed_at timestamp, "
    "rows_in bigint, rows_loaded bigint, rows_rejected bigint, rows_deduped bigint, status string"
)


@dataclass(frozen=True)
class Lake:
    """Folders of the layers under one root."""

    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def silver(self) -> str:
        return self.path("silver", "transactions")

    @property
    def rejected(self) -> str:
        return self.path("silver", "rejected")

    @property
    def audit(self) -> str:
        return self.path("silver", "dedup_audit")

    @property
    def runs(self) -> str:
        return self.path("silver", "runs")

    @property
    def fact(self) -> str:
        return self.path("gold", "sales")


def table(spark: SparkSession, lake: Lake) -> VersionedTable:
    """The clean layer: one row per transaction, in folders by month."""
    return VersionedTable(spark, lake.silver, SILVER_SCHEMA, KEY, PARTITION)


def latest(rows: DataFrame) -> DataFrame:
    """One row per transaction: latest landing time, then larger batch, then later arrival."""
    return latest_per_key(rows, KEY, [F.col(c).desc() for c in NEWEST])


def with_existing(current: DataFrame, silver: DataFrame) -> DataFrame:
    """Current rows and the stored rows of the same keys, told apart by ``origin``.

    A stored row of the very landing that is being taken again (a replay) does not compete
    with itself.
    """
    landings = current.select(*KEY, *[F.col(c).alias(f"_{c}") for c in NEWEST]).distinct()
    keys = landings.select(*KEY).distinct()
    same = [F.col(f"s.{c}") == F.col(f"l.{c}") for c in KEY] + [F.col(f"s.{c}").eqNullSafe(F.col(f"l._{c}")) for c in NEWEST]
    contested = silver.join(keys, KEY, "left_semi").select(*silver.columns)
    stored = contested.alias("s").join(landings.alias("l"), same, "left_anti")
    stored = stored.withColumns({"origin": F.lit("existing"), ARRIVAL: F.lit(0)})
    fresh = current.withColumns({"origin": F.lit("current"), ARRIVAL: F.lit(1)})
    return fresh.unionByName(stored, allowMissingColumns=True)


def tag_copies(rows: DataFrame) -> DataFrame:
    """Every copy with its key's winner (``kept``) and whether it is the winner itself.

    Copies that tie in all of these are told apart by their row number, where there is one.
    """
    order = F.struct(*NEWEST, *[c for c in (ARRIVAL, ROW) if c in rows.columns])
    winners = rows.groupBy(*KEY).agg(F.max(order).alias("kept"))
    return rows.join(winners, KEY).withColumn("is_kept", order == F.col("kept"))


def audit_rows(tagged: DataFrame, now: dt.datetime) -> DataFrame:
    return tagged.filter(~F.col("is_kept")).select(
        *KEY,
        F.col("kept.batch_id").alias("kept_batch_id"),
        F.col("batch_id").alias("dropped_batch_id"),
        F.col("kept.ingested_at").alias("kept_ingested_at"),
        F.col("ingested_at").alias("dropped_ingested_at"),
        F.lit(now).alias("deduped_at"),
    )


def as_silver(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "quantity": F.bround("quantity", 0).cast("int"),
        PARTITION: F.date_format("txn_timestamp", "yyyy-MM"),
    }).select(*SILVER_SCHEMA.names)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row of run counts with the reconciliation status."""
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).cast("bigint")
    o = F.col("outcome")
    current = F.col("origin") == "current"
    counts = outcomes.agg(
        n(current).alias("rows_in"),
        n(current & (o == "loaded")).alias("rows_loaded"),
        n(current & (o == "rejected")).alias("rows_rejected"),
        n(current & (o == "deduped")).alias("rows_deduped"),
    )
    return with_status(counts)


def with_status(counts: DataFrame) -> DataFrame:
    balanced = F.col("rows_in") == F.col("rows_loaded") + F.col("rows_rejected") + F.col("rows_deduped")
    return counts.withColumn("status", F.when(balanced, "ok").otherwise("reconciliation_warning"))


def prepare(adapted: DataFrame, product: DataFrame, month: dt.date | None, now: dt.datetime) -> DataFrame:
    """Adapted rows with reasons to reject, flags and a row number, written down once.

    The steps that follow read this copy: nothing is adapted again, and a row that is computed anew after the
    loss of an executor cannot get another number.
    """
    if "ingest_seq" not in adapted.columns:
        adapted = adapted.withColumn("ingest_seq", F.monotonically_increasing_id())
    adapted = adapted.withColumns({c: F.lit(None).cast("string") for c in RAW if c not in adapted.columns})
    # A catch-up load holds many months; its rows say which one they belong to.
    batch_month = F.col("batch_month") if month is None else F.lit(month.replace(day=1))
    flagged = quality.flag_late(quality.flag_sku_unmatched(quality.check(adapted, now), product), batch_month)
    return spool(flagged.withColumn(ROW, F.monotonically_increasing_id()), "prepared")


def classify(prepared: DataFrame, silver: DataFrame) -> DataFrame:
    """Each current row, and each stored row it competes with, with its outcome."""
    valid = prepared.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = prepared.filter(F.col("reject_reason").isNotNull())
    tagged = tag_copies(with_existing(valid, silver)).withColumn(
        "outcome", F.when(F.col("is_kept"), "loaded").otherwise("deduped"))
    return tagged.unionByName(
        rejected.withColumns({"origin": F.lit("current"), "outcome": F.lit("rejected")}),
        allowMissingColumns=True,
    )


def take_batch(spark: SparkSession, lake: Lake, adapted: DataFrame, product: DataFrame, month: dt.date | None,
               run_id: str, now: dt.datetime) -> tuple[dict, DataFrame]:
    """Take one batch of adapted rows (a month, or a catch-up of many) into the clean layer.

    Returns the run's counts and the clean rows that it has loaded.  The run starts from the commit before its own, if it has made
    one: called again with the same rows, after a crash at any step or none, it leaves what one
    call leaves.  Rejected rows, audit and log have a folder per run, which is replaced.
    """
    clean = table(spark, lake)
    base = clean.before(run_id)
    prepared = prepare(adapted, product, month, now)
    with little_disk(spark):
        silver = clean.holding(prepared.select(*KEY), base)
    rows = spool(classify(prepared, silver), "outcomes")
    discard(prepared)

    replace_run(rows.filter("outcome = 'rejected'").withColumn("rejected_at", F.lit(now)), lake.rejected, QUARANTINE_COLUMNS, run_id)
    contest = rows.filter("outcome <> 'rejected'")
    replace_run(audit_rows(contest, now), lake.audit, AUDIT_COLUMNS, run_id)
    # A stored row that keeps its place needs no rewrite.
    loaded = as_silver(contest.filter("outcome = 'loaded' and origin = 'current'"))
    clean.upsert(loaded, run_id, base)

    run = outcome_counts(rows).select(
        F.lit(run_id).alias("run_id"), F.lit(month and month.replace(day=1)).cast("date").alias("target_month"),
        F.lit(now).alias("started_at"), F.current_timestamp().alias("completed_at"), "*",
    ).first().asDict()
    log = spark.createDataFrame([run], RUN_SCHEMA)
    replace_run(log, lake.runs, [c for c in log.columns if c != "run_id"], run_id)
    return run, loaded


def process_batch(spark: SparkSession, lake: Lake, adapted: DataFrame, product: DataFrame, month: dt.date | None,
                  run_id: str, now: dt.datetime) -> dict:
    """``take_batch`` without the loaded rows: the run's counts."""
    return take_batch(spark, lake, adapted, product, month, run_id, now)[0]


def read_runs(spark: SparkSession, lake: Lake) -> DataFrame:
    """The run log."""
    return spark.read.schema(RUN_SCHEMA).parquet(lake.runs)


def run_totals(outcomes: DataFrame) -> DataFrame:
    """Landed rows per source and outcome with a TOTAL line.

    ``outcomes`` holds (source_system, outcome), one row per current row.
    """
    o = F.col("outcome")
    return outcomes.rollup("source_system").agg(
        F.count("*").alias("rows_in"),
        F.count_if(o == "loaded").alias("rows_loaded"),
        F.count_if(o == "rejected").alias("rows_rejected"),
        F.count_if(o == "deduped").alias("rows_deduped"),
    ).withColumn("source_system", F.coalesce("source_system", F.lit("TOTAL")))
