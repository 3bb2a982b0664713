"""Structured Streaming forms of landing, the monthly chain, first-wins and latest-wins dedup.

All queries take what is there and stop (``availableNow``); run again, each goes on
from its checkpoint.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basketry.functions.text import row_hash
from basketry.operators import gold, silver as S
from basketry.operators.adapter import adapt_all
from basketry.session import discard, spool
from basketry.sources import sinks
from basketry.sources.versions import VersionedTable

# Keeps dedup state on disk, so it may outgrow the executors' memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def land_stream(stream: DataFrame, path: str, checkpoint: str, source_system: str, batch_id: str) -> None:
    """Append arriving rows with all audit columns of landing, one batch id per micro-batch.

    ``source_file`` comes from the reader, ``ingest_seq`` numbers the rows of a micro-batch.  Each
    micro-batch has its own folder, so one that is replayed replaces itself.
    """
    hashed = row_hash(stream)
    arriving = stream.withColumns({"source_file": F.col("_metadata.file_path"), "row_hash": hashed})

    def land(rows: DataFrame, batch_number: int) -> None:
        sinks.replace_run(
            rows.withColumns({
                "source_system": F.lit(source_system), "batch_id": F.lit(f"{batch_id}_{batch_number}"),
                "ingested_at": F.current_timestamp(), "ingest_seq": F.monotonically_increasing_id()}),
            path, [*rows.columns, "source_system", "batch_id", "ingested_at", "ingest_seq"], f"{batch_id}_{batch_number}")

    _finish(
        arriving.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def chain_stream(landed: dict[str, DataFrame], lake: S.Lake, checkpoint: str, product: DataFrame, store: DataFrame,
                 calendar: DataFrame, now: dt.datetime, name: str) -> None:
    """Every micro-batch of landed rows through the clean layer into the fact.

    ``name`` tells the streams of a lake apart: with the batch number it is the run id.  A batch that is taken
    again after a crash at any step leaves what one call leaves.
    """
    def take(rows: DataFrame, batch_number: int) -> None:
        spark = rows.sparkSession
        run_id = f"{name}_{batch_number}"
        _, loaded = S.take_batch(spark, lake, rows, product, None, run_id, now)
        gold.promote(spark, lake, loaded, product, store, calendar, tag=run_id)
        discard(loaded)

    _finish(
        adapt_all(landed).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def first_wins(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Drop re-sends that arrive within the delay.

    This keeps the first copy where the batch chain keeps the latest, so it suits
    sources whose re-sends are identical.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


# Rows travel through the state operator as text, so that no type is changed on the way.
_AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _sortable(column: str, kind: T.DataType) -> Column:
    """Text whose order is that of the column's values, NULL first."""
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        c, kind = F.unix_micros(c), T.LongType()
    if isinstance(kind, T.DateType):
        c, kind = F.unix_date(c), T.IntegerType()
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    elif isinstance(kind, T.StringType):
        text = F.hex(F.encode(c, "UTF-8"))
    else:
        raise TypeError(f"{column}: cannot order a stream by {kind.simpleString()}")
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


def latest_wins(stream: DataFrame, keys: list[str], order: list[str], delay: str = "1 hour") -> DataFrame:
    """The newest row per key, sent on when it comes and again when a newer one corrects it.

    ``order`` starts with the event time; of equal rows the first to arrive stays.  Adds ``is_correction``: an earlier row
    of the key was sent before.  A key's state is one rank, kept on disk, and its timer drops it once the watermark has
    passed its row: what could still arrive in time is newer.  Rows that come later than ``delay`` are dropped.  Within a
    micro-batch a key's rows are read in pieces, so a hot key needs no more memory.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    time, kinds = order[0], {f.name: f.dataType for f in stream.schema}
    packed = stream.withWatermark(time, delay).select(
        F.col(time).alias("_time"), F.to_json(F.struct(*keys), _AS_TEXT).alias("_key"),
        F.concat_ws(" ", *[_sortable(c, kinds[c]) for c in order]).alias("_rank"),
        F.unix_millis(F.col(time).cast("timestamp")).alias("_millis"), F.to_json(F.struct(*stream.columns), _AS_TEXT).alias("_row"))

    def newest(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        best = (held or "", None, 0)
        for chunk in chunks:
            ranks = chunk["_rank"].tolist()
            i = max(range(len(ranks)), key=ranks.__getitem__, default=None)
            if i is not None and ranks[i] > best[0]:
                best = (ranks[i], chunk["_row"].iloc[i], int(chunk["_millis"].iloc[i]))
        if best[1] is not None:
            state.update((best[0],))
            state.setTimeoutTimestamp(max(best[2], state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({"_row": [best[1]], "is_correction": [held is not None]})

    sent = packed.groupBy("_key").applyInPandasWithState(
        newest, "_row string, is_correction boolean", "rank string", "append", GroupStateTimeout.EventTimeTimeout)
    return sent.select(F.from_json("_row", stream.schema, _AS_TEXT).alias("_r"), "is_correction").select("_r.*", "is_correction")


def keep_latest(stream: DataFrame, target: VersionedTable, order: list[str], checkpoint: str, name: str,
                delay: str = "1 hour") -> None:
    """Keep ``target`` at the newest row per key of all that has arrived in time; a replayed micro-batch changes nothing."""
    def take(rows: DataFrame, batch_number: int) -> None:
        # Written down first: an upsert reads its rows several times, the state is to be asked once.
        latest = spool(rows.select(*target.schema.names), "latest")
        target.upsert(latest, f"{name}_{batch_number}")
        discard(latest)

    _finish(
        latest_wins(stream, target.keys, order, delay).writeStream.foreachBatch(take).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    _finish(
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())
