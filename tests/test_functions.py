"""Column functions against written-down values."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.functions import amounts, dates, paths, text
from tallyspark.functions.categories import category


def values(spark, inputs, expr, kind="x string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)], f"i int, {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_amounts(spark):
    given = ["1.234,56", "1,234", "1,23", "+5", "(-5.00)", "2.345", "5.00-", "1e5", "-1.234,56", "12,34,56", "", ".", "$1234.56", "(25.00)", "1,234.56", None]
    want = ["1234.56", "1234.00", "1.23", "5.00", "-5.00", "2.35", "5.00", "15.00", "-1.23", None, None, None, "1234.56", "-25.00", "1234.56", None]
    assert [None if v is None else str(v) for v in values(spark, given, amounts.normalize_amount(F.col("x")))] == want


def test_dates(spark):
    given = ["01/15/2024", "2024-01-16", "25/12/2024", "2024-01-02 03:04:05", "1/2/69", "1/2/68", "15-01-2024", "January 5, 2024", "5 Jan 2024", "20240131", "2024-02-03T04:05:06Z", "January 1st, 2024", "never", "", None]
    want = ["2024-01-15", "2024-01-16", "2024-12-25", "2024-01-02", "1969-01-02", "2068-01-02", "2024-01-15", "2024-01-05", "2024-01-05", "2024-01-31", "2024-02-03", "2024-01-01", None, None, None]
    assert [None if v is None else str(v) for v in values(spark, given, dates.normalize_date(F.col("x")))] == want


def test_business_days(spark):
    rng, day = random.Random(1), dt.date(2024, 1, 1)
    pairs = [(dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (dt.date(2024, 1, 6), dt.date(2024, 1, 6)), (dt.date(2024, 1, 5), dt.date(2024, 1, 8)), (dt.date(2024, 1, 5), dt.date(2024, 1, 9)), (dt.date(2024, 1, 4), dt.date(2024, 1, 1))]
    pairs += [(day + dt.timedelta(rng.randrange(-9000, 9000)), day + dt.timedelta(rng.randrange(-9000, 9000))) for _ in range(200)]
    count = lambda a, b: sum((min(a, b) + dt.timedelta(k)).weekday() < 5 for k in range(abs((b - a).days) + 1))
    got = values(spark, pairs, dates.business_days(F.col("a"), F.col("b")), "a date, b date")
    assert got[:5] == [1, 0, 2, 3, 4]
    assert got == [count(a, b) for a, b in pairs]


def test_signature_text(spark):
    given = ["AMAZON MKTPL*NV46R2L51 Amzn.com/bill WA", "TST*MERCURYS COFFEE #0658 BELLEVUE WA", "Trader Joe's 123", "A & B LLC", "AMAZON.COM*4K2 X", "ORCA SEATTLE USA"]
    assert values(spark, given, text.signature_text(F.col("x"))) == ["amazon nv46r2l51", "mercurys coffee", "trader joe's", "a and b", "amazon.comk2 x", "orca seattle usa"]


def test_clean_description(spark):
    given = ["DEBIT POS STARBUCKS REF#12345", "POS DEBIT X", "  a  b ", "DEBIT ", None]
    assert values(spark, given, text.clean_description(F.col("x"))) == ["STARBUCKS", "DEBIT X", "a b", "DEBIT", ""]


def test_category(spark):
    given = [("DELTA AIR SEAT FEES", "-24.00", "credit"), ("Payment Thank You-Mobile", "5109.43", "credit"), ("ORCA SEATTLE USA", "6.00", "credit"), ("PAYSEND Credit", "-50.00", "debit"), ("DEPOSIT PAYROLL", "2000.00", "debit"),
             ("OLB EXTERNAL TRANSFER", "-10.00", "debit"), ("EXTERNAL TRANSFER TO X", "-10.00", "debit"), ("DIVIDEND", "0.00", "debit")]
    got = values(spark, given, category(F.col("d"), F.col("a").cast("decimal(18,2)"), F.col("t")), "d string, a string, t string")
    assert got == ["spending", "internal_transfer", "refund", "spending", "income", "external_transfer", "internal_transfer", "income"]


def test_paths(spark):
    given = ["raw/chase/statements-8147-.pdf", "raw/o'neil/x.csv", "in/td-1.csv", "in/ab_x.csv", "a/55512345/z.csv", "in/account_123456.csv", "in/1999_20240101_98765.csv"]
    assert values(spark, given, paths.institution(F.col("x"))) == ["Chase", "O'Neil", "TD Bank", "unknown", "Z.Csv", "Account", "1999"]
    assert values(spark, given, paths.account(F.col("x"))) == ["8147", "unknown", "unknown", "unknown", "2345", "3456", "8765"]


def test_transaction_type(spark):
    given = ["TRANSFER TO SAVINGS", "DEPOSIT FROM X", "CHASE CREDIT CRD", "THANK YOU", "POS 12", "IMPOSSIBLE", "", None, "CHOCOLATE"]
    assert values(spark, given, text.transaction_type(F.col("x"))) == ["transfer_out", "transfer_in", "transfer_out", "income", "spending", "unknown", "unknown", "unknown", "spending"]
