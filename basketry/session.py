"""Session settings and the shared folder for written intermediates."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every query relies on; all of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Settings of jobs that sort every row of a large table: a task's rows fit its memory, whatever the table's size.
SMALL_TASKS = {
    "spark.sql.files.maxPartitionBytes": "8MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # Partitions are only ever merged: with few of them, one would grow with the table.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}

# What a job has shuffled is deleted at its end, nothing else reads it; written tables are packed tightly.
LITTLE_DISK = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}

_local_scratch: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read smaller splits and merge shuffle partitions to smaller ones, so their sorts need not spill."""
    with _settings(spark, SMALL_TASKS):
        yield


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files behind, and the tables they write are small."""
    with _settings(spark, LITTLE_DISK):
        yield


def local_session(app: str = "basketry", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="basketry-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    ``local_session`` sets it.  Another session in one process (``local[n]``) may do without; where
    executors are processes of their own the setting is required, as they see no temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app_id = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/basketry/{app_id}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app_id not in _local_scratch:
        _local_scratch[app_id] = tempfile.mkdtemp(prefix="basketry-")
    return f"{_local_scratch[app_id]}/{app_id}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the tables this session has written; its frames cannot be read afterwards."""
    return drop_path(spark, scratch_root(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def drop_path(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(jvm_path, True)


def spool(df, label: str = "spool"):
    """Write ``df`` to the shared folder and read it back.

    Used where a frame feeds several later steps: it is computed once, and losing an
    executor afterwards costs a re-read rather than a re-run of its lineage.  What the write has
    shuffled is deleted with it, so a chain of steps takes the disk of its largest, not of all.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    with little_disk(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames) -> None:
    """Delete the tables of spooled frames that no later step reads."""
    for df in frames:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            drop_path(df.sparkSession, folder)
