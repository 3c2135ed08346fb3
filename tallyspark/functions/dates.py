"""Dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats, in the order in which they are tried. Those of two-digit years are read as 1969 to 2068.
DATE_FORMATS = ["M/d/yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "M/d/yy", "d/M/yy", "yy-M-d"]
MORE_FORMATS = [
    "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "d/M/yyyy H:m:s", "M-d-yyyy H:m:s", "d-M-yyyy H:m:s", "yyyy/M/d H:m:s",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd", "MMddyyyy", "ddMMyyyy",
]
STATEMENT_FORMATS = ["M/d/yy", "M/d/yyyy", "M-d-yy", "M-d-yyyy"]


def stripped(c: Column) -> Column:
    """Without white space (of Unicode too) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _try(c: Column, fmt: str) -> Column:
    t = F.try_to_timestamp(c, F.lit(fmt)).cast("date")
    two_digits = "yy" in fmt and "yyyy" not in fmt
    return F.when(F.year(t) >= 2069, F.add_months(t, -1200)).otherwise(t) if two_digits else t


def normalize_date(text: Column, formats: list[str] | None = None) -> Column:
    """The first format that fits; else the start of an ISO date and time; else the formats again without 1st, 2nd, ...; else null.
    A caller's formats stand in for the usual first eight."""
    s = stripped(text)
    tried = [*(formats or DATE_FORMATS), *MORE_FORMATS]
    iso = F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}:\d{2}", 1), F.lit("yyyy-MM-dd")).cast("date")
    plain = F.regexp_replace(s, r"(\d+)(st|nd|rd|th)", "$1")
    return F.coalesce(*[_try(s, f) for f in tried], iso, *[F.when(plain != s, _try(plain, f)) for f in tried])


def statement_date(text: Column) -> Column:
    s = F.nullif(stripped(text), F.lit(""))  # a text that isn't there fits no format, and need not be tried
    return F.coalesce(*[_try(s, f) for f in STATEMENT_FORMATS])


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def _weekdays_until(d: Column) -> Column:
    n = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days(a: Column, b: Column) -> Column:
    """Weekdays from the earlier to the later date, both included: one weekday to itself is 1."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (_weekdays_until(high) - _weekdays_until(F.date_sub(low, 1))).cast("int")


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")
