"""Amounts of money as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MONEY
from .dates import stripped


def money(c: Column) -> Column:
    return c.cast(MONEY)


def normalize_amount(text: Column) -> Column:
    """Decimal of a written amount, rounded half up to cents; null if there are no digits.

    Currency signs and white space go. A comma is a decimal sign in 1.234,56 and before exactly two last digits, else it groups
    thousands. Parentheses or a leading minus negate; all other characters are left out."""
    c = F.regexp_replace(stripped(text), r"(?U)[$£€¥₹\s]", "")
    no_comma = F.replace(c, F.lit(","), F.lit(""))
    both, comma = c.contains(",") & c.contains("."), c.contains(",")
    comma_first = F.locate(",", F.reverse(c)) > F.locate(".", F.reverse(c))
    plain = (
        F.when(c.rlike(r"^\d{1,3}(\.\d{3})*,\d{2}$"), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.when(comma_first, no_comma).otherwise(c))
        .when(comma, F.when(c.rlike(r",\d{2}$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(no_comma))
        .otherwise(c)
    )
    enclosed = plain.startswith("(") & plain.endswith(")")
    digits = F.regexp_replace(plain, r"[^\d.]", "")
    value = F.expr("null").cast(MONEY)
    value = F.when(~digits.isin("", "."), F.round(digits.try_cast("decimal(28,6)"), 2).try_cast(MONEY)).otherwise(value)
    return F.when(enclosed | plain.startswith("-"), -value).otherwise(value).cast(MONEY)


def credit_less_debit(credit: Column, debit: Column) -> Column:
    """Of a pair of columns; blank counts as 0, both blank is null."""
    c, d = normalize_amount(credit), normalize_amount(debit)
    return F.when(c.isNull() & d.isNull(), None).otherwise(F.coalesce(c, F.lit(0)) - F.coalesce(d, F.lit(0))).cast(MONEY)


def cents_text(amount: Column) -> Column:
    """Two digits after the point."""
    return F.bround(amount, 2).cast(MONEY).cast("string")


def tolerance_score(days: Column, a: Column, b: Column) -> Column:
    """Days apart, and 10 or 20 more if the amounts differ by up to 5 % or 10 % of the larger; null beyond."""
    diff, top = F.abs(F.abs(a) - F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return F.when(diff == 0, days).when(diff < top * F.lit("0.05").cast("decimal(3,2)"), days + 10).when(diff < top * F.lit("0.10").cast("decimal(3,2)"), days + 20)


def money_text(c: Column) -> Column:
    """+$1,234.00 or -$1,234.00."""
    return F.concat(F.when(c >= 0, "+$").otherwise("-$"), F.format_number(F.abs(c), 2))
