"""Files as rows: path, length, format."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..operators.graph import materialise

# Supported file names, and what tells the formats apart by content.
SUPPORTED = [".qfx", ".ofx", ".csv", ".pdf"]
OFX_MARKS = ["ofxheader", "<ofx>", "<signonmsgsrsv1>", "<bankmsgsrsv1>", "<creditcardmsgsrsv1>", "<stmttrn>", "data:ofxsgml", "version:"]
CSV_WORDS = ["date", "amount", "description", "transaction", "balance", "debit", "credit", "account"]


#: Bytes and files of a task, at most, and bytes that it hands on at a time.
PART_BYTES, PART_FILES, BATCH_BYTES = 32 << 20, 20_000, 4 << 20


def _local(folder: str) -> str | None:
    """The path of a folder on a local (or mounted) disk; None if another store has it, or it does not exist or is a pattern, all of which Spark's reader sees to."""
    path = folder.removeprefix("file:")
    path = "/" + path.lstrip("/") if path != folder else path
    return os.path.abspath(path) if "://" not in path and not set(path) & set("*?[]{}\\") and os.path.exists(path) else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def _entries(folder: str, recursive: bool, end: str) -> Iterator[tuple[str, int, int]]:
    """path, modification time in microseconds and length of files, one after another; empty files are passed over, as Spark's readers do."""
    about = lambda path, s: (f"file:{path}", s.st_mtime_ns // 1_000_000 * 1000, s.st_size)
    if os.path.isfile(folder):
        if folder.lower().endswith(end) and os.stat(folder).st_size:
            yield about(folder, os.stat(folder))
        return
    todo = [folder]
    while todo:
        at = todo.pop()
        with os.scandir(at) as entries:
            for e in entries:
                if _hidden(e.name):
                    continue
                if e.is_dir():
                    todo += [e.path] * recursive
                elif e.name.lower().endswith(end) and e.stat().st_size:
                    yield about(e.path, e.stat())


def _listed(spark: SparkSession, folders: list[str], recursive: bool, end: str) -> DataFrame:
    """path, modificationTime and length of files of local folders, as a table: a folder is listed in a task, and the driver sees none of its files."""
    kinds = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("id").to_pylist():
                found = _entries(folders[n], recursive, end)
                while some := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds.types, strict=True)], schema=kinds)

    return materialise(spark.range(0, len(folders), 1, len(folders)).mapInArrow(work, "path string, modificationTime timestamp, length long"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, size, held = 0, 0, []
        for n, path in enumerate(batch.column("path").to_pylist(), 1):
            with open(path.removeprefix("file:"), "rb") as f:
                held.append(f.read())
            size += len(held[-1])
            if n == batch.num_rows or size > BATCH_BYTES:
                yield batch.slice(start, n - start).append_column("content", pa.array(held, pa.binary()))
                start, size, held = n, 0, []


def scan(spark: SparkSession, folders: list[str], recursive: bool = True, ending: str | None = None, content: bool = True) -> DataFrame:
    """path, modificationTime, length and content (if asked for) of the files in folders, without those of another ending (any case).

    Folders of local or mounted disks are listed and read by tasks; those of other stores by Spark's reader, which lists them in the driver.
    A folder that does not exist is an error, as with every Spark reader."""
    end = "." + ending.lower().lstrip(".") if ending else ""
    local = [_local(f) for f in folders]
    if None in local or not local:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folders)
        files = files.where(F.lower("path").endswith(end)) if end else files
        return files if content else files.drop("content")
    local = sorted(set(local))
    if recursive:
        local = [f for f in local if not any(f != g and f.startswith(g.rstrip("/") + "/") for g in local)]
    files = _listed(spark, local, recursive, end)
    if not content:
        return files
    n = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-n["files"] // PART_FILES), -(-n["bytes"] // PART_BYTES))
    return files.repartition(parts, "path").mapInArrow(_contents, "path string, modificationTime timestamp, length long, content binary")


def supported(files: DataFrame) -> DataFrame:
    """Files with a supported ending that aren't empty."""
    return files.where(extension(F.col("path")).isin(SUPPORTED) & (F.col("length") > 0))


def looks_like_ofx(head: Column) -> Column:
    first = F.lower(F.array_join(F.slice(F.split(head, "\n"), 1, 10), "\n"))
    return F.greatest(*[first.contains(m) for m in OFX_MARKS])


def looks_like_csv(head: Column) -> Column:
    lines = F.split(head, "\n")
    return F.get(lines, 0).contains(",") & (F.greatest(*[F.lower(F.get(lines, 0)).contains(w) for w in CSV_WORDS]) | (F.size(lines) > 1))


def file_format() -> Column:
    """csv, qfx or pdf, of rows with path and content: by ending if the content agrees, else by content; null if neither."""
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    pdf, ofx, csv = head.startswith("%PDF-"), looks_like_ofx(head), looks_like_csv(head)
    end = extension(F.col("path"))
    by_name = F.when((end == ".pdf") & pdf, "pdf").when(end.isin(".qfx", ".ofx") & ofx, "qfx").when((end == ".csv") & csv, "csv")
    return F.coalesce(by_name, F.when(pdf, "pdf").when(ofx, "qfx").when(csv, "csv"))


def detected(files: DataFrame) -> DataFrame:
    return files.withColumn("format", file_format())


def by_format(files: DataFrame) -> DataFrame:
    """format, n_files and paths, without files of no known format. Paths per format are for display."""
    return detected(files).where("format is not null").groupBy("format").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("paths"))
