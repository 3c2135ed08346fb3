"""OFX and QFX files (SGML with or without closed tags, or XML), by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, paths, text

# What shows an OFX file in its first 1024 bytes.
MARKS = ["OFXHEADER", "<OFX>", "QFXHEADER"]


def valid(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 1024), "UTF-8")
    return F.greatest(*[head.contains(m) for m in MARKS])


def tag(block: Column, *names: str) -> Column:
    """The value of the first of the tags that has one."""
    value = lambda n: F.nullif(F.trim(F.regexp_extract(block, rf"(?i)<{n}>([^<\r\n]*)", 1)), F.lit(""))
    return F.coalesce(*[value(n) for n in names])


def account(statement: Column) -> Column:
    """Account id, else number, else routing number, else unknown; the last four of a longer number."""
    a = F.coalesce(tag(statement, "ACCTID", "ACCTNUM", "BANKID"), F.lit("unknown"))
    return F.when((F.length(a) > 4) & F.replace(a, F.lit("-"), F.lit("")).rlike(r"^\d+$"), F.right(a, F.lit(4))).otherwise(a)


def read(files: DataFrame) -> DataFrame:
    """Transactions and problems of files (path, content): statements times their transactions, memo before payee."""
    whole = F.decode("content", "UTF-8")
    statements = F.regexp_extract_all(whole, F.lit(r"(?is)(<(?:CC)?STMTRS>.*?(?=<(?:CC)?STMTRS>|\z))"), 1)
    each = files.where(valid(F.col("content"))).select(F.col("path").alias("source_file"), F.posexplode(statements).alias("nth", "statement"))
    rows = each.select("source_file", "nth", account(F.regexp_extract("statement", r"(?is)^(.*?)(?:<STMTTRN>|\z)", 1)).alias("account"), F.posexplode(F.regexp_extract_all("statement", F.lit(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|\z)"), 1)).alias("row", "t"))
    numbered = rows.withColumn("line_no", (F.col("nth") * 1_000_000 + F.col("row") + 1).cast("int"))
    return projected(numbered)


def projected(rows: DataFrame) -> DataFrame:
    """Transactions and problems of the text of transactions (source_file, line_no, account, t)."""
    t = F.col("t")
    out = rows.select(
        "source_file", "line_no", F.try_to_date(F.substring(tag(t, "DTPOSTED", "DTUSER"), 1, 8), "yyyyMMdd").alias("date"),
        F.replace(tag(t, "TRNAMT"), F.lit(","), F.lit("")).try_cast("decimal(18,2)").alias("amount"),
        F.coalesce(F.nullif(text.clean_description(tag(t, "MEMO", "NAME", "PAYEE")), F.lit("")), F.lit("Unknown transaction")).alias("description"),
        "account", paths.institution(F.col("source_file")).alias("institution"), tag(t, "FITID").alias("transaction_id"), F.lit(None).cast("string").alias("category"), amounts.normalize_amount(tag(t, "BALAMT")).alias("balance"),
    )
    return out.withColumn("problem", F.when(F.col("date").isNull(), "bad date").when(F.col("amount").isNull(), "bad amount"))
