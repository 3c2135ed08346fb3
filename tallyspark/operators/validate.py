"""Validation of rows and of written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import stripped
from ..model import STANDARD_COLUMNS

LARGE = 1_000_000


def _messages(*checks: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))


def row_errors(as_of_year: int) -> Column:
    """Messages of a row, in order; those that begin with Warning count as errors where any message rejects."""
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit("")) == ""
    return _messages(
        (F.col("date").isNull(), "Invalid date: must be datetime object"),
        (F.col("amount").isNull(), "Invalid amount: must be Decimal object"),
        (F.col("amount") == 0, "Warning: Transaction amount is zero"),
        (blank("description"), "Description cannot be empty"),
        (~blank("description") & (F.length(stripped(F.col("description"))) < 2), "Description too short (minimum 2 characters)"),
        (blank("account"), "Account cannot be empty"),
        (blank("institution"), "Institution cannot be empty"),
        (F.col("transaction_id").isNotNull() & blank("transaction_id"), "Transaction ID cannot be empty string (use None instead)"),
        (F.col("category").isNotNull() & blank("category"), "Category cannot be empty string (use None instead)"),
        ((F.year("date") < 1900) | (F.year("date") > as_of_year + 1), F.concat(F.lit("Date year "), F.year("date").cast("string"), F.lit(" seems unreasonable"))),
        (F.abs("amount") > LARGE, "Warning: Transaction amount is very large"),
    )


def validated(txns: DataFrame, as_of_year: int) -> DataFrame:
    return txns.withColumn("errors", row_errors(as_of_year))


def split_valid(txns: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Rows without any message, and the rejected rows with their messages."""
    v = validated(txns, as_of_year)
    return v.where(F.size("errors") == 0).drop("errors"), v.where(F.size("errors") > 0)


def summary(txns: DataFrame, as_of_year: int) -> DataFrame:
    """total, valid (no message but warnings), with_errors, with_warnings, error_messages."""
    v = validated(txns, as_of_year)
    warning = F.exists("errors", lambda e: e.startswith("Warning:"))
    hard = F.exists("errors", lambda e: ~e.startswith("Warning:"))
    return v.agg(F.count("*").alias("total"), F.count_if(~hard).alias("valid"), F.count_if(hard).alias("with_errors"), F.count_if(warning).alias("with_warnings"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("messages"))


def repeated_rows(rows: DataFrame, columns: list[str], order: str = "txn_seq") -> DataFrame:
    """rows with duplicate: whether an earlier row is the same in all the columns."""
    return rows.withColumn("duplicate", F.row_number().over(W.partitionBy(*columns).orderBy(order)) > 1)


def written_errors(rows: DataFrame, columns: list[str] | None = None, most: int | None = 100) -> DataFrame:
    """Up to `most` + 1 rows (all, if most is None) of a written file (all strings) that have errors, with the messages; order: line.

    Checked: date, amount and balance formats, no more than two decimals, required fields, ids of three characters or more, the
    account type, and rows that stand twice."""
    columns = columns or STANDARD_COLUMNS
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in columns else F.lit("x")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)$"
    v = repeated_rows(rows, columns, "line")
    e = _messages(
        (F.try_to_date(value("date"), "yyyy-MM-dd").isNull(), "Invalid date format"),
        (~value("amount").rlike(number), "Invalid amount format"),
        (value("amount").rlike(r"\.\d{3,}$"), "Amount has more than 2 decimal places"),
        (value("description") == "", "Description is empty"),
        (value("account") == "", "Account is empty"),
        (value("institution") == "", "Institution is empty"),
        ((value("transaction_id") != "") & (F.length(value("transaction_id")) < 3) if "transaction_id" in columns else F.lit(False), "Transaction ID too short"),
        ((value("balance") != "") & ~value("balance").rlike(number) if "balance" in columns else F.lit(False), "Invalid balance format"),
        (~value("account_type").isin("debit", "credit") if "account_type" in columns else F.lit(False), "Invalid account type"),
        (F.col("duplicate"), "Duplicate row detected"),
    )
    found = v.withColumn("errors", e).where(F.size("errors") > 0).orderBy("line")
    return found if most is None else found.limit(most + 1)
