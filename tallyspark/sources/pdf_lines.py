"""Transactions from the text lines and tables of PDF statements.

`pdf.read` gives lines (path, page, line_no, line) and table rows (path, page, line_no, header, cells); line_no is unique in a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, dates, paths, text
from ..operators.graph import materialise
from ..operators.signs import statement_sign
from ..operators.texts import FEW, with_text
from . import pdf

# Written dates and amounts, statement periods, and headers of tables, in the order in which they are tried.
DATES = [r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{1,2}-\d{1,2}-\d{4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b"]
AMOUNTS = [r"\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}", r"\(\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}\)"]
_day = r"(\d{1,2}/\d{1,2}/\d{2,4})"
PERIODS = [rf"Opening/Closing Date\s+{_day}\s*[-–]\s*{_day}", rf"Statement Period[:\s]+{_day}\s*[-–]\s*{_day}", rf"Statement Date[:\s]+{_day}", rf"Closing Date\s+{_day}"]
#: Characters that the first page must have.
LEAST_TEXT = 10
SHORT_LINE = r"^(\d{1,2}/\d{1,2})\s+(.+?)\s+([-]?\d+\.\d{2})$"
TABLE_HEADERS = {
    "date": ["date", "trans.*date", "posting.*date", "effective.*date"],
    "description": ["description", "memo", "details", "transaction", "payee"],
    "amount": ["amount", "debit", "credit", "withdrawal", "deposit"],
    "balance": ["balance", "running.*balance", "account.*balance"],
}


def _found(c: Column, patterns: list[str], group: int = 0) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


def is_transaction_line(line: Column) -> Column:
    return (_found(line, DATES).isNotNull() & _found(line, AMOUNTS).isNotNull()) | F.trim(line).rlike(SHORT_LINE)


def period(first_page: Column, path: Column) -> Column:
    """start and end of a statement: from its first page, else the end from eight digits in the path (years 2000 to 2100)."""
    ends = [(dates.statement_date(F.regexp_extract(first_page, p, 1)), dates.statement_date(F.regexp_extract(first_page, p, 2))) for p in PERIODS[:2]]
    only = [dates.statement_date(F.regexp_extract(first_page, p, 1)) for p in PERIODS[2:]]
    digits = F.try_to_date(F.regexp_extract(path, r"(\d{8})", 1), "yyyyMMdd")
    named = F.when(F.year(digits).between(2000, 2100), digits)
    return F.struct(F.coalesce(*[F.when(b.isNotNull(), a) for a, b in ends]).alias("start"), F.coalesce(*[b for _, b in ends], *only, named).alias("end"))


def year_of(month: Column, start: Column, end: Column, this_year: int) -> Column:
    """Of a date without year: that of the statement's start or end if it spans two years, else its end's, else this_year."""
    spans = F.month(start) > F.month(end)
    return F.coalesce(F.when(spans, F.when(month >= F.month(start), F.year(start)).otherwise(F.year(end))).otherwise(F.year(end)), F.lit(this_year))


def transactions(lines: DataFrame, this_year: int, among: DataFrame | None = None) -> DataFrame:
    """Transactions of lines (path, page, line_no, line), or of those of them in `among`; the period is in the lines of the first page."""
    one = lines.where("page = 1").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("first_page"))
    periods = one.select("path", period(F.col("first_page"), F.col("path")).alias("period"))
    rows = (lines if among is None else among).where(is_transaction_line(F.col("line")))
    line = F.trim("line")
    short = line.rlike(SHORT_LINE)
    part = lambda i: F.regexp_extract(line, SHORT_LINE, i)
    found_date, found_amount = _found(line, DATES), _found(line, AMOUNTS)
    raw = F.when(short, part(2)).otherwise(F.replace(F.replace(line, found_date, F.lit("")), found_amount, F.lit("")))
    # to a table, so that what several columns need is found once a line
    rows = materialise(rows.select(
        "path", "line_no", short.alias("short"), part(1).alias("month_day"), F.when(~short, found_date).alias("written"), F.when(short, part(3)).otherwise(found_amount).alias("amount"),
        F.when(short, part(2)).alias("raw"), text.clean_description(raw).alias("cleaned"),
    ))
    rows = with_text(rows, "written", "long_date", dates.normalize_date).join(periods, "path", "left")
    month, day = F.split("month_day", "/")[0].try_cast("int"), F.split("month_day", "/")[1].try_cast("int")
    short_date = F.try_to_date(F.concat_ws("-", year_of(month, F.col("period.start"), F.col("period.end"), this_year), month, day), "yyyy-M-d")
    # the short form's sign words are sought in the raw description, the general form's in the cleaned one
    signed = statement_sign(amounts.normalize_amount(F.col("amount")), F.when(F.col("short"), F.col("raw")).otherwise(F.col("cleaned")))
    out = rows.select(
        F.col("path").alias("source_file"), "line_no", F.when(F.col("short"), short_date).otherwise(F.col("long_date")).alias("date"),
        signed.cast("decimal(18,2)").alias("amount"), F.col("cleaned").alias("description"),
        paths.account(F.col("path")).alias("account"), paths.institution(F.col("path")).alias("institution"), F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("decimal(18,2)").alias("balance"),
    )
    return out.withColumn("problem", F.when(F.col("date").isNull(), "bad date").when(F.col("amount").isNull(), "bad amount"))


def table_columns(header: list[str | None]) -> dict[str, int] | None:
    """Field to column: the first header that fits; null without date and amount."""
    out: dict[str, int] = {}
    for i, h in enumerate(header):
        for field, patterns in TABLE_HEADERS.items():
            if h and field not in out and any(re.search(p, h.lower().strip()) for p in patterns):
                out[field] = i
    return out if {"date", "amount"} <= out.keys() else None


def table_transactions(tables: DataFrame) -> DataFrame:
    """Transactions of table rows (path, page, line_no, header array, cells array), with page: of tables whose header names a date and an
    amount, rows that have both. The header's layouts are few, so each is found once per distinct header, by a join."""
    columns = F.udf(lambda header: table_columns(header or []), "map<string,int>")
    layouts = materialise(tables.select("header").distinct().withColumn("at", columns("header")).where("at is not null"))
    rows = tables.join(F.broadcast(layouts) if layouts.count() <= FEW else layouts, "header")
    cell = lambda name: F.get("cells", F.try_element_at("at", F.lit(name)))
    raw = F.coalesce(cell("description"), F.lit(""))
    amount = amounts.normalize_amount(F.trim(cell("amount")))
    rows = rows.where((F.coalesce(cell("date"), F.lit("")) != "") & (F.coalesce(cell("amount"), F.lit("")) != ""))
    out = with_text(rows.withColumn("__written", F.trim(cell("date"))), "__written", "__date", dates.normalize_date).select(
        F.col("path").alias("source_file"), "page", "line_no", F.col("__date").alias("date"),
        statement_sign(amount, raw).cast("decimal(18,2)").alias("amount"), text.clean_description(raw).alias("description"), paths.account(F.col("path")).alias("account"), paths.institution(F.col("path")).alias("institution"),
        F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("category"), amounts.normalize_amount(F.nullif(F.trim(cell("balance")), F.lit(""))).alias("balance"),
    )
    return out.withColumn("problem", F.when(F.col("date").isNull(), "bad date").when(F.col("amount").isNull(), "bad amount"))


def table_maps(tables: DataFrame) -> DataFrame:
    """Rows of tables (path, page, header array, cells array) as maps; rows of another width than their header are left out."""
    return tables.where(F.size("header") == F.size("cells")).select("path", "page", F.map_from_arrays("header", "cells").alias("row"))


def pattern_hits(lines: DataFrame) -> DataFrame:
    """All written dates and amounts of each line that has any."""
    every = lambda ps: F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(p), 0) for p in ps]))
    return lines.select("path", "page", "line_no", every(DATES).alias("dates"), every(AMOUNTS).alias("amounts")).where("size(dates) + size(amounts) > 0")


def statements(files: DataFrame, this_year: int) -> DataFrame:
    """Transactions and problems of PDF files (path, content): of each page those of its tables, and of its lines only if no table gives any.

    A file that can't be read, or has less than LEAST_TEXT characters on its first page, gives one bad row."""
    return of_rows(pdf.read(files), this_year)


def of_rows(rows: DataFrame, this_year: int) -> DataFrame:
    """The same of rows of pdf.SCHEMA, which are computed once, to a table."""
    found = materialise(rows)
    lines = found.where("kind = 'line'").select("path", "page", "line_no", "line")
    rows = materialise(table_transactions(found.where("kind = 'row'")))
    good = rows.where("problem is null").select(F.col("source_file").alias("path"), "page").distinct()
    from_tables = rows.join(good.withColumnRenamed("path", "source_file"), ["source_file", "page"], "left_semi").drop("page")
    from_lines = transactions(lines, this_year, lines.join(good, ["path", "page"], "left_anti"))
    text = F.sum(F.when((F.col("page") == 1) & (F.col("kind") == "line"), F.length("line") + 1))
    about = found.groupBy("path").agg(F.max(F.when(F.col("kind") == "error", F.col("line"))).alias("error"), text.alias("text"))
    bad = about.select("path", F.coalesce("error", F.when(F.coalesce("text", F.lit(0)) - 1 < LEAST_TEXT, "no readable text")).alias("problem")).where("problem is not null")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("date", "date"), ("amount", "decimal(18,2)"), *[(c, "string") for c in ("description", "account", "institution", "transaction_id", "category")], ("balance", "decimal(18,2)"))]
    unread = bad.select(F.col("path").alias("source_file"), F.lit(0).alias("line_no"), *nothing, "problem")
    given = from_tables.unionByName(from_lines).join(bad.select(F.col("path").alias("source_file")), "source_file", "left_anti")
    return given.unionByName(unread)
