"""Append-only landing of raw rows with audit columns."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions.text import row_hash
from basketry.operators.latest import latest_per_key
from basketry.session import path_exists, spool
from basketry.sources.sinks import append
from basketry.sources.versions import create_once, names_in, read_text

AUDIT = ["source_system", "source_file", "batch_id", "ingested_at", "row_hash"]


def with_audit(df: DataFrame, source_system: str, source_file: str, batch_id: str,
               ingested_at: dt.datetime) -> DataFrame:
    """All rows of a landing share its time; ``ingest_seq`` orders them inside it."""
    return df.withColumns({
        "source_system": F.lit(source_system),
        "source_file": F.lit(source_file),
        "batch_id": F.lit(batch_id),
        "ingested_at": F.lit(ingested_at),
        "row_hash": row_hash(df),
        "ingest_seq": F.monotonically_increasing_id(),
    })


def land(df: DataFrame, path: str, source_system: str, source_file: str, batch_id: str,
         ingested_at: dt.datetime) -> int:
    """Append one batch and return its row count. Landing again adds the rows again."""
    rows = with_audit(df, source_system, source_file, batch_id, ingested_at)
    return append(rows, path, rows.columns, ["batch_id"])


#: Rows that one landing may have; its number leads the sequence number.
LANDING_ROWS = 1 << 40


def numbered(df: DataFrame, first: int = 0, column: str = "ingest_seq") -> DataFrame:
    """Rows numbered from ``first`` without a gap, in the order of the partitions.

    The rows are written down with their place in their partition; the partitions' counts give each one's
    first number, so nothing is sorted and no task sees more than its own rows.
    """
    placed = spool(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    counts = sorted(placed.groupBy(part.alias("_part")).count().collect())  # one row per partition
    starts, at = [], first
    for row in counts:
        starts.append((row["_part"], at))
        at += row["count"]
    start = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (placed.withColumn("_part", part).join(F.broadcast(start), "_part")
            .withColumn(column, F.col("_start") + place).drop("_part", "_start", "_place"))


def landing_number(spark: SparkSession, path: str, batch_id: str) -> int:
    """The number of a batch's landing among those of the folder: given once, in order, and kept."""
    journal = f"{path.rstrip('/')}/_landings"
    while True:
        taken = [n for n in names_in(spark, journal) if n[0] != "." and n.endswith(".txt")]
        for name in taken:
            if read_text(spark, f"{journal}/{name}") == batch_id:
                return int(name.removesuffix(".txt"))
        number = 1 + max((int(n.removesuffix(".txt")) for n in taken), default=0)
        if create_once(spark, f"{journal}/{number:010d}.txt", batch_id):
            return number


def land_once(df: DataFrame, path: str, source_system: str, source_file: str, batch_id: str, ingested_at: dt.datetime) -> DataFrame:
    """The rows of a batch as they were first landed; a second call lands nothing.

    ``ingest_seq`` grows from landing to landing and within one, so no two rows of the folder share it.  A landing
    that broke off is written anew.
    """
    spark = df.sparkSession
    number = landing_number(spark, path, batch_id)
    done = f"{path.rstrip('/')}/_landings/{number:010d}.done"
    if not path_exists(spark, done):
        rows = numbered(with_audit(df, source_system, source_file, batch_id, ingested_at).drop("ingest_seq"), number * LANDING_ROWS)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        create_once(spark, done, "")
    if not any(n.startswith("batch_id=") for n in names_in(spark, path)):
        return with_audit(df.limit(0), source_system, source_file, batch_id, ingested_at)
    return read_batch(spark, path, batch_id)


def read_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """One batch only: the filter is on the folder column, so other batches are not read."""
    return spark.read.parquet(path).filter(F.col("batch_id") == batch_id)


def latest_dim(landed: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Newest landed row per key."""
    order = order or ["ingested_at"]
    return latest_per_key(landed, keys, [F.col(c).desc() for c in order])
