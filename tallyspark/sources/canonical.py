"""Canonical transaction files, as the library writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..model import REQUIRED_COLUMNS, STANDARD_COLUMNS
from .csv_files import headers, numbered
from .files import scan

# Folders of the first level, and files, that aren't sources.
SKIPPED_FOLDERS = ["total", "processed", "reports"]
SKIPPED_FILES = ["total.csv", "all_transactions.csv"]


def discovered(spark: SparkSession, data_dir: str) -> DataFrame:
    """CSV files (path, content) below data_dir, without those of the skipped folders of its first level."""
    root = data_dir.rstrip("/")
    below = F.regexp_extract("path", r"^.*" + "".join("\\" + ch if not ch.isalnum() else ch for ch in root.removeprefix("file://")) + r"/([^/]+)/", 1)
    return scan(spark, [root], ending="csv").where((below != "") & ~below.isin(SKIPPED_FOLDERS))


def missing_columns(header: list[str]) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in header]


def _raw(spark: SparkSession, files: DataFrame) -> DataFrame:
    out = None
    for line, where in headers(files):
        names = line.split(",")
        if lack := missing_columns(names):
            raise ValueError(f"{where[0]}: missing columns {', '.join(lack)}")
        rows = numbered(spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("multiLine", True).csv(where))
        have = [F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in STANDARD_COLUMNS]
        part = rows.select(*have, "source_file", "line_no")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no canonical files")
    return out


def _typed(raw: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        "source_file", "line_no", F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.col("amount").try_cast("decimal(18,2)").alias("amount"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("account", F.lit("")).alias("account"), F.coalesce("institution", F.lit("")).alias("institution"), blank("transaction_id").alias("transaction_id"), blank("category").alias("category"),
        blank("balance").try_cast("decimal(18,2)").alias("balance"), F.coalesce(blank("account_name"), F.col("account")).alias("account_name"), F.coalesce(blank("account_type"), F.lit("debit")).alias("account_type"),
        F.col("date").alias("__date"), F.col("amount").alias("__amount"), blank("balance").alias("__balance"),
    )


def read_strict(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Transactions of files; the first bad date, amount or balance ends the job with file, line and field."""
    t = _typed(_raw(spark, files))
    bad = F.when(F.col("date").isNull(), "date").when(F.col("amount").isNull(), "amount").when(F.col("__balance").isNotNull() & F.col("balance").isNull(), "balance")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat_ws(" ", F.col("source_file"), F.lit("line"), F.col("line_no").cast("string"), F.lit("field"), bad)).cast("date")).otherwise(F.col("date"))
    return t.withColumn("date", checked).drop("__date", "__amount", "__balance")


def read_lenient(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows with a good date; a bad amount still ends the job."""
    t = _typed(_raw(spark, files)).where("date is not null")
    amount = F.when(F.col("amount").isNull(), F.raise_error(F.concat_ws(" ", F.col("source_file"), F.lit("bad amount"), F.col("__amount"))).cast("decimal(18,2)")).otherwise(F.col("amount"))
    return t.withColumn("amount", amount).drop("__date", "__amount", "__balance")


def combined(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below folder by column name (missing ones null), with source_file: the file's name. Rows without a number as
    amount are left out."""
    files = scan(spark, [folder], ending="csv").where(~file_name(F.col("path")).isin(SKIPPED_FILES))
    out = None
    for line, where in headers(files):
        part = spark.read.schema(", ".join(f"`{n}` string" for n in line.split(","))).option("header", True).option("multiLine", True).csv(where).withColumn("source_file", file_name(F.col("_metadata.file_path")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV files below {folder}")
    return out.withColumn("amount", F.col("amount").try_cast("decimal(18,2)")).where("amount is not null")
