"""State of processed files: which to process, history, summaries.

The state is a log. A batch appends a table with the rows of its files and then commits it: a small file with the next number, which can only be
created once, names it. Readers take the tables that are named since the last whole one, and of each file the row of the latest commit. A batch
that breaks off before its commit changes nothing; one that is repeated under the same stream and number is not appended again. After MOST tables
a commit names a whole table in their place; tables are deleted when a second whole one follows, so that readers under way still find theirs."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import FILE_STATE

#: Tables of batches that are read together, at most.
MOST = 20


class Log:
    """The commits of a state folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._path("_log").getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """Commits in order, from the last but one whole table on. A file that was broken off while it was written is no commit."""
        if not self._fs.exists(self._path("_log")):
            return []
        # compaction bounds the number of these files
        rows = self.spark.read.text(f"{self.path}/_log", wholetext=True).collect()
        out = []
        for r in rows:
            try:
                out.append(json.loads(r["value"]))
            except ValueError:
                continue
        return sorted(out, key=lambda c: c["version"])

    def current(self) -> list[dict]:
        """The commits whose tables make up the state."""
        out = self.commits()
        whole = max((i for i, c in enumerate(out) if c["whole"]), default=0)
        return out[whole:]

    def committed(self, stream: str, batch: int) -> bool:
        """Whether this batch of a stream, or a later one, is in the state."""
        last = self.current()[-1:]
        return bool(last) and last[0]["streams"].get(stream, -1) >= batch

    def read(self) -> DataFrame:
        """FILE_STATE: the latest row of each file."""
        parts = [self.spark.read.schema(FILE_STATE).parquet(f"{self.path}/{c['table']}").withColumn("__version", F.lit(c["version"])) for c in self.current()]
        if not parts:
            return self.spark.createDataFrame([], FILE_STATE)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return latest(rows, [F.col("__version"), F.col("last_processed")]).select(FILE_STATE.names)

    def append(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Commit rows of files (FILE_STATE, or a part of it). A batch of a stream that is in the state already is left out."""
        if stream is not None and self.committed(stream, batch):
            return
        have = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FILE_STATE]
        self._commit(rows.select(have), False, {stream: batch} if stream is not None else {})
        if len(self.current()) > MOST:
            self.replace(self.read())

    def replace(self, rows: DataFrame) -> None:
        """Commit rows as the whole state."""
        old = self.commits()
        self._commit(rows.select(FILE_STATE.names), True, {})
        wholes = [i for i, c in enumerate(old) if c["whole"]]
        for c in old[: wholes[-1] if wholes else 0]:
            self._fs.delete(self._path(c["table"]), True)
            self._fs.delete(self._path("_log", f"{c['version']:012d}.json"), True)

    def _commit(self, rows: DataFrame, whole: bool, streams: dict[str, int]) -> None:
        table = f"t-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}")
        last = self.current()[-1:]
        folder = self._path("_log")
        # the number after all names, also those of commits that were broken off
        taken = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        version = 1 + max((int(n.split(".")[0]) for n in taken if n.endswith(".json")), default=-1)
        about = {"version": version, "table": table, "whole": whole, "streams": (last[0]["streams"] if last else {}) | streams}
        # fails if another writer has taken the number: its rows then stay, and this batch is repeated
        out = self._fs.create(self._path("_log", f"{version:012d}.json"), False)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()


def load(spark: SparkSession, path: str) -> DataFrame:
    """The state; empty if there is none."""
    return Log(spark, path).read()


def latest(rows: DataFrame, by: list) -> DataFrame:
    """Of each file the row that is largest by these columns."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("file_path").agg(F.max_by(whole, F.struct(*by)).alias("__row")).select("__row.*")


def upserted(state: DataFrame, results: DataFrame) -> DataFrame:
    """The last row of each file: those of results come after those of state."""
    both = state.withColumn("__new", F.lit(0)).unionByName(results.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [F.col("__new"), F.col("last_processed")]).drop("__new")


def unsettled(listing: DataFrame, state: DataFrame, existing_outputs: DataFrame | None = None) -> DataFrame:
    """listing (path, modificationTime, length, without content) of files that may have changed: all but those of the same size and time that were
    processed with success and whose output is there. Only these need to be read."""
    old = state.where("success").select(F.col("file_path").alias("path"), F.col("file_size").alias("__size"), F.col("modified").alias("__modified"), "output_file")
    both = listing.join(old, "path", "left")
    same = (F.col("__size") == F.col("length")) & (F.col("__modified") == F.col("modificationTime"))
    if existing_outputs is not None:
        both = both.join(existing_outputs.select("output_file", F.lit(True).alias("__there")).distinct(), "output_file", "left")
        same = same & F.coalesce("__there", F.lit(False))
    return both.where(~F.coalesce(same, F.lit(False))).select(*listing.columns)


def to_process(files: DataFrame, state: DataFrame, existing_outputs: DataFrame | None = None, force: bool = False) -> DataFrame:
    """files (file_path, file_hash) that are new or changed, failed last time, or whose output (output_file) is gone."""
    if force:
        return files
    old = state.select("file_path", F.col("file_hash").alias("__hash"), F.col("success").alias("__ok"), "output_file")
    both = files.join(old, "file_path", "left")
    skip = (F.col("__hash") == F.col("file_hash")) & F.col("__ok")
    if existing_outputs is not None:
        both = both.join(existing_outputs.select("output_file", F.lit(True).alias("__there")).distinct(), "output_file", "left")
        skip = skip & F.coalesce("__there", F.lit(False))
    return both.where(~F.coalesce(skip, F.lit(False))).select(*files.columns)


def prevention(files: DataFrame, state: DataFrame, existing_outputs: DataFrame) -> DataFrame:
    """What is known of files (file_path, file_hash) that were processed before: when, with what result, whether the file changed, whether
    its output is there, and whether it would be processed again."""
    there = existing_outputs.select("output_file", F.lit(True).alias("__there")).distinct()
    old = state.select("file_path", F.col("file_hash").alias("__hash"), "last_processed", "success", "transaction_count", "output_file")
    both = files.select("file_path", "file_hash").join(old, "file_path").join(there, "output_file", "left")
    changed, exists = F.col("__hash") != F.col("file_hash"), F.coalesce("__there", F.lit(False))
    return both.select(
        "file_path", "last_processed", F.col("success").alias("previous_success"), F.col("transaction_count").alias("previous_transaction_count"), F.col("output_file").alias("previous_output_file"),
        changed.alias("file_changed"), exists.alias("output_file_exists"), (changed | ~exists | ~F.col("success")).alias("should_reprocess"),
    )


def history(state: DataFrame, as_of: dt.datetime, days: int = 30, institution: str | None = None) -> DataFrame:
    """Files of the last days, latest first; institution is a part of the path."""
    out = state.where(F.col("last_processed") >= F.lit(as_of - dt.timedelta(days=days)))
    return (out.where(F.col("file_path").contains(institution)) if institution else out).orderBy(F.desc("last_processed"), "file_path")


def cleaned(state: DataFrame, existing: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """state without old rows whose file (file_path) is gone; rows without a date go too."""
    old = F.col("last_processed").isNull() | (F.col("last_processed") < F.lit(as_of - dt.timedelta(days=days)))
    there = existing.select("file_path", F.lit(True).alias("__there")).distinct()
    return state.join(there, "file_path", "left").where(~(old & (F.col("__there").isNull() | F.col("last_processed").isNull()))).drop("__there")


def hashed(files: DataFrame) -> DataFrame:
    """(file_path, file_hash, file_size, modified) of files with content."""
    return files.select(F.col("path").alias("file_path"), F.md5("content").alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
