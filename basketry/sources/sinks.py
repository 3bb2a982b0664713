"""Writes: append, insert-if-absent, replace-a-run and CSV export, on Parquet folders."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from basketry.session import little_disk, path_exists


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _by_folder(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring the rows of a folder together before a partitioned write.

    The hint lets AQE split a folder that is too large and join small ones, so neither a
    hot partition nor thousands of small files result.
    """
    return df.hint("rebalance", *columns)


def _rows_written(seen: Observation, written: DataFrame) -> int:
    """Rows counted while writing.

    AQE drops the metrics node together with an input it finds empty at run time.  Only that is
    taken for no rows: any other failure to read the count is raised.
    """
    try:
        return int(seen.get["rows"])
    except Py4JJavaError:
        if written.isEmpty():
            return 0
        raise


def append(df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None) -> int:
    """Append the named columns; the count is taken while writing, not by a second pass.

    It is observed above the last exchange, in the writing tasks themselves: each counts
    once, however often an earlier stage had to run again.
    """
    seen = Observation()
    out = df.select(*columns)
    if partition_by:
        out = _by_folder(out, partition_by)
    writer = out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with little_disk(df.sparkSession):
        writer.parquet(path)
    return _rows_written(seen, out)


def absent_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks; one row per key.

    The target is first cut to the keys of the source, so a small batch against a
    large target moves only matching keys.
    """
    wanted = source.select(*keys).distinct()
    present = target.select(*keys).join(wanted, keys, "left_semi").distinct()
    return source.join(present, keys, "left_anti").dropDuplicates(keys)


def insert_absent(spark: SparkSession, source: DataFrame, path: str, keys: list[str],
                  partition_by: list[str] | None = None) -> int:
    """Append rows with new keys and return how many; a second run inserts none."""
    target = read_or_empty(spark, path, source.schema)
    fresh = absent_rows(source, target, keys)
    return append(fresh, path, source.columns, partition_by)


def replace_run(df: DataFrame, path: str, columns: list[str], run_id: str) -> None:
    """Write the rows of one run into its own folder; a replay of the run replaces them."""
    with little_disk(df.sparkSession):
        (
            df.select(*columns, F.lit(run_id).alias("run_id")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
