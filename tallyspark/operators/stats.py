"""Summaries of data sets, files, errors and batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .graph import materialise

MONEY = "decimal(18,2)"


def _dataset() -> list[Column]:
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
    return [
        F.count("*").alias("transactions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        money(F.when(F.col("amount") < 0, F.col("amount"))).alias("spending"), money(F.when(F.col("amount") > 0, F.col("amount"))).alias("income"), money(F.col("amount")).alias("net"),
    ]


def dataset_summary(txns: DataFrame) -> DataFrame:
    return txns.agg(*_dataset())


def summarised(txns: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """dataset_summary of txns, collected while `write` writes them: no second scan. write must compute its input once."""
    seen = Observation(f"summary-{uuid.uuid4().hex}")
    write(txns.observe(seen, *_dataset()))
    return txns.sparkSession.createDataFrame([tuple(seen.get.values())], dataset_summary(txns).schema)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and the observation whose `n` is the number of its rows once something has computed it."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def counts_by(txns: DataFrame, column: str) -> DataFrame:
    return txns.groupBy(column).agg(F.count("*").alias("transactions")).orderBy(F.desc("transactions"), column)


def common_keys(txns: DataFrame, column: F.Column, a: F.Column, b: F.Column) -> DataFrame:
    """Values that rows of both kinds have."""
    return txns.where(a).select(column.alias("value")).intersect(txns.where(b).select(column.alias("value")))


def id_frequency(txns: DataFrame) -> DataFrame:
    return txns.where("transaction_id is not null and transaction_id <> ''").groupBy("transaction_id").agg(F.count("*").alias("times")).where("times > 1")


def import_statistics(before: DataFrame, removal: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A removal's result as a table, and (input_count, final_count, removed_count), counted while that is written."""
    given, seen = counted(before)
    after, kept = counted(removal(given))
    table = materialise(after)
    n, left = seen.get["n"], kept.get["n"]
    return table, before.sparkSession.createDataFrame([(n, left, n - left)], "input_count long, final_count long, removed_count long")


def batch_summary(files: DataFrame) -> DataFrame:
    """One row over the results of files (FILE_STATE): counts, rates, the largest and the slowest file."""
    return files.agg(
        F.count("*").alias("total_files"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("long").alias("transactions"), F.count_distinct("output_file").alias("output_files"),
        F.round(F.try_divide(F.count_if("success"), F.count("*")), 6).alias("success_rate"), F.round(F.try_divide(F.sum("transaction_count"), F.sum("processing_time")), 4).alias("per_second"),
        F.max_by("file_path", F.struct("file_size", "file_path")).alias("largest_file"), F.max_by("file_path", F.struct("processing_time", "file_path")).alias("slowest_file"),
    )


def institution_files(files: DataFrame) -> DataFrame:
    """Files, rows, failures and mean time of each institution."""
    return files.groupBy("institution").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("long").alias("transactions"), F.count_if(~F.col("success")).alias("failed"),
        F.round(F.avg("processing_time"), 6).alias("mean_time"), F.count_distinct("output_file").alias("output_files"),
    )


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("category").agg(F.count("*").alias("errors"), F.count_distinct("file_path").alias("files"))


def common_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    return errors.groupBy("code").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "code").limit(n)
