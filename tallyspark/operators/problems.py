"""Errors of a batch as rows, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ERROR
from . import stats

#: Code, severity and category of a problem by how its text begins; the first that fits, the last one else.
KINDS = [
    ("missing columns", "F002", "error", "file_format"), ("bad ", "D001", "warning", "data_parsing"), ("no transactions", "F003", "error", "file_format"), ("", "V001", "warning", "data_validation"),
]


def rows(rejected: DataFrame, results: DataFrame) -> DataFrame:
    """ERROR rows of rejected lines (source_file, line_no, problem), and of files (FILE_STATE) without a surviving row."""
    failed = results.where("not success").select(F.col("file_path").alias("source_file"), F.lit(None).cast("int").alias("line_no"), F.lit("no transactions").alias("problem"))
    every = rejected.select("source_file", "line_no", "problem").union(failed)
    pick = lambda i: F.coalesce(*[F.when(F.col("problem").startswith(k[0]), k[i]) for k in KINDS])
    return every.select(
        pick(1).alias("code"), pick(2).alias("severity"), pick(3).alias("category"), F.col("problem").alias("message"), F.col("source_file").alias("file_path"), F.col("line_no").cast("long").alias("line"),
        F.create_map(F.lit("problem"), F.col("problem")).alias("context"),
    ).to(ERROR)


def of_file(errors: DataFrame, path: str) -> DataFrame:
    return errors.where(F.col("file_path") == path)


def report(errors: DataFrame) -> DataFrame:
    """One row: errors and warnings in all and by category, files with errors, and the five most frequent errors."""
    bad, warned = errors.where("severity <> 'warning'"), errors.where("severity = 'warning'")
    by = lambda df, name: df.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias(name))
    top = stats.common_errors(bad).agg(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("minus"), "code", "times"))).alias("x")).select(F.transform("x", lambda v: F.struct(v["code"].alias("code"), v["times"].alias("times"))).alias("most_common"))
    one = errors.agg(F.count_if(F.col("severity") != "warning").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct(F.when(F.col("severity") != "warning", F.col("file_path"))).alias("files_with_errors"))
    return one.join(by(bad, "errors_by_category")).join(by(warned, "warnings_by_category")).join(top)
