"""Whole flows: ingest files, consolidate canonical files, report months."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state as states
from .functions import paths
from .functions.paths import extension
from .model import ACCOUNT, FILE_STATE
from .operators import dedup, enrich, problems, signs, stats, validate
from .operators.graph import materialise
from .operators.ranks import summed_before
from .plugins import Registry, built_in
from .sinks import output_path
from .sources import canonical
from .sources.accounts import Config
from .sources.files import scan, supported


def sequenced(rows: DataFrame) -> DataFrame:
    """With txn_seq from source_file and line_no: files in order of path, lines within. Files are ranged by path over all tasks."""
    sizes = rows.groupBy("source_file").agg(F.max("line_no").cast("long").alias("__n"))
    before = summed_before(sizes, [F.col("source_file")], "__n", "__offset").drop("__n")
    return rows.join(before, "source_file").withColumn("txn_seq", F.col("__offset") + F.col("line_no")).drop("__offset")


@dataclass
class Ingested:
    transactions: DataFrame
    rejected: DataFrame
    results: DataFrame
    errors: DataFrame
    #: Rows of the state of files that were written again without a change, with their new time.
    touched: DataFrame


def ingest(spark: SparkSession, folders: list[str], as_of: dt.datetime, accounts: DataFrame | None = None, state: DataFrame | None = None, registry: Registry | None = None, force: bool = False, recursive: bool = True, config: Config | None = None, outputs: DataFrame | None = None, only: DataFrame | None = None) -> Ingested | None:
    """Parse new and changed files, set signs by file, validate (any message rejects), remove exact duplicates per file, enrich.

    Each file is read by the one parser that the registry chooses for its path and institution. config: date formats, headers and
    institution names. outputs (output_file): what is written already; a file whose output is gone is processed again. only (path): the files to look at; all by default. results has a row of
    FILE_STATE per file; a file without a surviving row has failed and is tried again. errors has a row of ERROR per problem. None if there is nothing to
    process."""
    config = config or Config()
    registry = registry or built_in(as_of.year, config.date_formats, config.column_overrides)
    files = scan(spark, folders, recursive).where((extension(F.col("path")).isin([e.lower() for e in registry.formats()])) & (F.col("length") > 0))
    force = force or config.force_reprocess or not config.skip_processed
    if only is not None:
        files = files.join(only, "path", "left_semi")
    if state is not None and not force:
        # sizes and times come from the listing alone; files older than the first that may have changed are then left out of the scan
        may = materialise(states.unsettled(files.select("path", "modificationTime", "length"), state, outputs))
        since = may.agg(F.min("modificationTime").alias("t")).first()["t"]
        files = files.where(F.col("modificationTime") >= F.lit(since)).join(may.select("path"), "path", "left_semi")
    hashed = materialise(states.hashed(files))
    todo = materialise(states.to_process(hashed, state, outputs, force)) if state is not None else hashed
    institution = paths.institution(F.col("path"), config.institution_mappings)
    chosen = materialise(registry.chosen(files.select("path").join(todo.select(F.col("file_path").alias("path")), "path", "left_semi"), institution))
    parts = []
    for (name,) in chosen.where("parser is not null").select("parser").distinct().orderBy("parser").collect():
        parts.append(registry.parsers[name].read(spark, files.join(chosen.where(F.col("parser") == name).select("path"), "path", "left_semi")))
    names = ["source_file", "line_no", "date", "amount", "description", "account", "institution", "transaction_id", "category", "balance", "problem"]
    if not parts:
        return None
    parsed = parts[0].select(names)
    for p in parts[1:]:
        parsed = parsed.unionByName(p.select(names))
    if config.institution_mappings:
        parsed = parsed.withColumn("institution", paths.institution(F.col("source_file"), config.institution_mappings))
    parsed = materialise(sequenced(parsed))
    good = signs.corrected(parsed.where("problem is null"))
    valid, invalid = validate.split_valid(good, as_of.year)
    rows = enrich.enriched(dedup.exact(valid), accounts if accounts is not None else spark.createDataFrame([], ACCOUNT)).drop("problem", "line_no")
    rows = materialise(rows)
    rejected = invalid.select("source_file", "line_no", F.array_join("errors", "; ").alias("problem")).union(parsed.where("problem is not null").select("source_file", "line_no", "problem"))
    counts = rows.groupBy(F.col("source_file").alias("file_path")).agg(F.count("*").alias("transaction_count"), F.first("institution").alias("institution"))
    results = todo.join(counts, "file_path", "left").select(
        "file_path", "file_hash", F.lit(as_of).alias("last_processed"), output_path(F.col("file_path"), F.coalesce("institution", F.lit("Unknown"))).alias("output_file"), F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        (F.coalesce("transaction_count", F.lit(0)) > 0).alias("success"), F.lit(None).cast("double").alias("processing_time"), "file_size", F.coalesce("institution", F.lit("Unknown")).alias("institution"), "modified",
    )
    return Ingested(rows, rejected, results, problems.rows(rejected, results), _touched(hashed, todo, state))


def _touched(hashed: DataFrame, todo: DataFrame, state: DataFrame | None) -> DataFrame:
    same = hashed.join(todo.select("file_path"), "file_path", "left_anti").select("file_path", F.col("modified").alias("__modified"))
    if state is None:
        return hashed.sparkSession.createDataFrame([], FILE_STATE)
    return state.join(same, "file_path").withColumn("modified", F.col("__modified")).select(FILE_STATE.names)


def batches(spark: SparkSession, folders: list[str], size: int, recursive: bool = True) -> list[list[str]]:
    """Paths of the supported files, by name, in lists of `size`, for runs that save their state between batches."""
    found = [r["path"] for r in supported(scan(spark, folders, recursive)).select("path").orderBy("path").collect()]
    return [found[i : i + size] for i in range(0, len(found), size)]


def consolidated(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """All canonical files as one set, duplicates across files merged; and how many rows were read, are left and were removed."""
    given = sequenced(canonical.read_strict(spark, canonical.discovered(spark, data_dir))).drop("line_no")
    return stats.import_statistics(given, dedup.import_merged)


def consolidate(spark: SparkSession, data_dir: str) -> DataFrame:
    return consolidated(spark, data_dir)[0]
