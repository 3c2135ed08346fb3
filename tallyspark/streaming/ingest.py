"""Incremental ingestion with Structured Streaming.

`follow` ingests files as they arrive: a micro-batch parses its files, writes their canonical folders (which replace those of the same files) and then
commits their rows to the state's log under the batch's number. A batch that is run again after a failure finds its number there, or repeats writes that replace
themselves, so each file counts once. A file source remembers paths only; so each batch also looks at the listing for known files whose size or time has changed, and `catch_up`
does so when nothing new arrives."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sinks, state
from ..model import TRANSACTION
from ..operators.dedup import SIGNATURE, signed
from ..pipeline import ingest

FILES = "path string, modificationTime timestamp, length long, content binary"


def canonical_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Transactions (Parquet, TRANSACTION) as they arrive in folder."""
    return spark.readStream.schema(TRANSACTION).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clusters(stream: DataFrame, gap_days: int = 3, late_days: int = 7) -> DataFrame:
    """Clusters of equal signature whose neighbours are at most gap_days apart, as session windows; late rows up to late_days."""
    timed = signed(stream).withColumn("at", F.to_timestamp("date")).withWatermark("at", f"{late_days} days")
    return timed.groupBy(*SIGNATURE, F.session_window("at", f"{gap_days} days").alias("w")).agg(F.count("*").alias("n"), F.min_by("txn_seq", F.struct("date", "txn_seq")).alias("first_seq"))


def start(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ingested(spark: SparkSession, folder: str, out: str, log: state.Log, now: Callable[[], dt.datetime], only: DataFrame | None, stream: str | None, number: int) -> bool:
    known = log.read()
    got = ingest(spark, [folder], now(), state=known, outputs=sinks.written(spark, out), only=only)
    if got is not None:
        sinks.write_canonical(got.transactions, out)
    rows = got.results.unionByName(got.touched) if got is not None else known.limit(0)
    if got is not None or stream is not None:
        log.append(rows, stream, number)
    return got is not None


def follow(spark: SparkSession, folder: str, out: str, state_path: str, checkpoint: str, stream: str = "follow", files_per_batch: int = 100, now: Callable[[], dt.datetime] = dt.datetime.now, available_now: bool = True) -> StreamingQuery:
    """Ingest the files of folder (and below) to canonical files in out, once each. stream names this query in the state's log."""

    def batch(files: DataFrame, number: int) -> None:
        log = state.Log(files.sparkSession, state_path)
        if log.committed(stream, number):
            return
        changed = state.unsettled(_listing(files.sparkSession, folder), log.read())
        known = log.read().select(F.col("file_path").alias("path"))
        only = files.select("path").union(changed.join(known, "path", "left_semi").select("path")).distinct()
        _ingested(files.sparkSession, folder, out, log, now, only, stream, number)

    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    writer = source.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def catch_up(spark: SparkSession, folder: str, out: str, state_path: str, now: Callable[[], dt.datetime] = dt.datetime.now) -> bool:
    """Ingest what is new or has changed in folder, outside of a stream; whether there was any."""
    return _ingested(spark, folder, out, state.Log(spark, state_path), now, None, None, 0)
