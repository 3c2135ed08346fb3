"""Bank CSV files of any known header."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import amounts, dates, paths, text
from ..model import TRANSACTION

# Accepted headers by field, spelt exactly so.
HEADERS = {
    "date": ["date", "transaction_date", "posting_date", "Date", "Transaction Date", "Posting Date", "trans_date", "Trans Date", "DATE", "TRANSACTION_DATE", "transaction date", "posting date", "effective_date", "Effective Date",
             "Transaction Post Date", "transaction post date", "TRANSACTION POST DATE", "Started Date", "started date", "Completed Date", "completed date"],
    "amount": ["amount", "Amount", "transaction_amount", "debit_credit", "Debit", "Credit", "AMOUNT", "TRANSACTION_AMOUNT", "transaction amount", "Amount ($)", "Amount($)", "debit", "credit", "net_amount", "Net Amount", "transaction_value", "value"],
    "description": ["description", "Description", "memo", "details", "Memo", "Details", "DESCRIPTION", "MEMO", "DETAILS", "transaction_description", "payee", "Payee", "merchant", "Merchant", "reference", "Reference", "narration",
                    "Description of Transaction", "description of transaction", "DESCRIPTION OF TRANSACTION", "Transaction Description", "transaction description", "TRANSACTION DESCRIPTION"],
    "account": ["account", "Account", "account_number", "Account Number", "ACCOUNT", "ACCOUNT_NUMBER", "account number", "acct", "Acct", "account_id", "Account ID", "Product", "product", "PRODUCT"],
    "transaction_id": ["transaction_id", "Transaction ID", "id", "ID", "trans_id", "Trans ID", "TRANSACTION_ID", "reference_number", "Reference Number", "check_number", "Check Number", "confirmation", "Confirmation"],
    "balance": ["balance", "Balance", "running_balance", "Running Balance", "BALANCE", "account_balance", "Account Balance", "current_balance", "Current Balance"],
    "transaction_type": ["transaction_type", "Transaction Type", "type", "Type", "trans_type", "TRANSACTION_TYPE", "TYPE", "transaction type"],
}
NULLS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>"]


def mapped(headers: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Field to header: the first header that fits each field. A header with `debit` and another with `credit` stand in for an amount."""
    low = [h.lower() for h in headers]
    debit = next((h for h, x in zip(headers, low, strict=True) if "debit" in x), None)
    credit = next((h for h, x in zip(headers, low, strict=True) if "credit" in x and h != debit), None)
    pair = {"debit": debit, "credit": credit} if debit and credit else {}
    out = {f: h for f, names in HEADERS.items() if not (pair and f == "amount") for h in [next((x for x in headers if x.strip() in names), None)] if h}
    return pair | out | {f: h for f, h in (overrides or {}).items() if isinstance(h, str) and h in headers}


def missing(mapping: dict[str, str]) -> list[str]:
    need = [f for f in ("date", "description") if f not in mapping]
    return need + ([] if "amount" in mapping or {"debit", "credit"} <= mapping.keys() else ["amount"])


def headers(files: DataFrame) -> list[tuple[str, list[str]]]:
    """Header line and paths of each kind of file; there are as many as banks have layouts. files: path, content."""
    line = F.regexp_replace(F.split(F.decode("content", "UTF-8"), "\r?\n", 2)[0], "^﻿", "")
    return [(r["line"], r["paths"]) for r in files.select("path", line.alias("line")).groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("line").collect()]


def numbered(rows: DataFrame) -> DataFrame:
    """With line_no: the place in the file, from the start of the part that a task read and the order within it."""
    rows = rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__in", F.monotonically_increasing_id())
    return rows.withColumn("line_no", F.row_number().over(W.partitionBy("source_file").orderBy("__start", "__in"))).drop("__start", "__in")


def _field(mapping: dict[str, str], name: str) -> Column:
    c = F.trim(F.col(f"`{mapping[name]}`")) if name in mapping else F.lit(None).cast("string")
    return F.when(c.isin(NULLS), None).otherwise(c)


def projected(rows: DataFrame, mapping: dict[str, str], date_formats: list[str] | None = None) -> DataFrame:
    """Transactions and their problems (null if fine) of raw string rows with source_file and line_no."""
    f = lambda n: _field(mapping, n)
    kind = paths.title(F.replace(f("transaction_type"), F.lit("_"), F.lit(" ")))
    amount = amounts.credit_less_debit(f("credit"), f("debit"))
    if "amount" in mapping:
        amount = F.coalesce(amounts.normalize_amount(f("amount")), amount)
    out = rows.select(
        "source_file", "line_no", dates.normalize_date(f("date"), date_formats).alias("date"), amount.alias("amount"),
        F.coalesce(F.nullif(text.clean_description(f("description")), F.lit("")), kind, F.lit("Unknown transaction")).alias("description"),
        paths.account(F.col("source_file"), f("account")).alias("account"), paths.institution(F.col("source_file")).alias("institution"),
        f("transaction_id").alias("transaction_id"), F.lit(None).cast("string").alias("category"), amounts.normalize_amount(f("balance")).alias("balance"),
    )
    return out.withColumn("problem", F.when(F.col("date").isNull(), "bad date").when(F.col("amount").isNull(), "bad amount"))


def read(spark: SparkSession, files: DataFrame, date_formats: list[str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Transactions of all CSV files (path, content), good and bad rows (problem). One scan per layout of header; a layout that lacks
    a required column gives one bad row per file."""
    out = None
    for line, where in headers(files):
        names = next(csv.reader([line]), [])
        mapping = mapped(names, overrides)
        if lack := missing(mapping):
            part = spark.createDataFrame([(p,) for p in where], "source_file string").selectExpr("source_file", "0 as line_no", "cast(null as date) as date", "cast(null as decimal(18,2)) as amount", *[f"cast(null as string) as {c}" for c in ("description", "account", "institution", "transaction_id", "category")], "cast(null as decimal(18,2)) as balance", f"'missing columns: {', '.join(lack)}' as problem")
        else:
            schema = ", ".join(f"`{n}` string" for n in names)
            part = projected(numbered(spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).csv(where)), mapping, date_formats)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], TRANSACTION).selectExpr("source_file", "cast(0 as int) as line_no", "date", "amount", "description", "account", "institution", "transaction_id", "category", "balance", "cast(null as string) as problem")
