"""Institution and account from paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal

# Parts of file names by institution, in the order in which they are tried, and special spellings.
INSTITUTION_PARTS = {
    "chase": ["chase"], "bank_of_america": ["bofa", "bankofamerica", "boa"], "wells_fargo": ["wellsfargo", "wells"], "citi": ["citi", "citibank"],
    "capital_one": ["capitalone", "capital"], "american_express": ["amex", "americanexpress"], "discover": ["discover"], "usaa": ["usaa"], "pnc": ["pnc"],
    "td_bank": ["tdbank", "td"], "first_tech": ["firsttech", "first_tech"], "gemini": ["gemini"],
}
SPELLINGS = {"Bofa": "Bank of America", "Boa": "Bank of America", "Amex": "American Express", "Usaa": "USAA", "Pnc": "PNC", "Td Bank": "TD Bank", "Td": "TD Bank"}
# Where a file name shows an account, in the order in which it is sought.
EXACT_ACCOUNTS = [r"(?i)statements-(\d{4})-", r"(?i)chase(\d{4})_", r"(?i)(\d{4})_activity"]
ACCOUNT_PARTS = [r"(?i)account[_-]?(\d{4,})", r"(?i)acct[_-]?(\d{4,})", r"(?i)(\d{4,})[_-]?account", r"(?i)(\d{4,})[_-]?acct"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def title(c: Column) -> Column:
    """Capitals after every character that is no letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def standard_institution(name: Column) -> Column:
    t = title(F.replace(name, F.lit("_"), F.lit(" ")))
    known = F.coalesce(*[F.when(t == k, v) for k, v in SPELLINGS.items()], t)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(known)


def institution(path: Column, mappings: dict[str, str] | None = None) -> Column:
    """The folder below `raw` (mapped, if known), else a known part of the file name, else its first word if longer than two letters,
    else unknown."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "raw")
    folder = F.when((at > 0) & (at < F.size(parts)), F.lower(F.get(parts, at.cast("int"))))
    mapped = F.coalesce(*[F.when(folder == k, v) for k, v in (mappings or {}).items()], folder)
    name = F.lower(file_name(path))
    known = F.coalesce(*[F.when(name.rlike(literal(words)), k) for k, words in INSTITUTION_PARTS.items()])
    first = F.split(F.replace(name, F.lit("-"), F.lit("_")), "_")[0]
    return standard_institution(F.coalesce(mapped, known, F.when(F.length(first) > 2, first), F.lit("")))


def account_number(c: Column) -> Column:
    """Last four digits of a longer number, shorter ones filled with zeros; else up to eight word characters."""
    s = F.trim(c)
    word = F.substring(F.regexp_replace(s, r"(?U)[^\w]", ""), 1, 8)
    return F.when(s == "", "unknown").when(s.rlike(r"^\d{5,}$"), F.right(s, F.lit(4))).when(s.rlike(r"^\d{1,4}$"), F.lpad(s, 4, "0")).otherwise(word)


def account(path: Column, field: Column | None = None) -> Column:
    """From a field of the data, else from the file name, else from the folders above it (the nearest first), else unknown."""
    name = file_name(path)
    found = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    runs = F.regexp_extract_all(name, F.lit(r"(\d{4,})"), 1)

    def no_date(d: Column) -> Column:
        year = F.substring(d, 1, 4).try_cast("int").between(1900, 2100)
        month, day = F.substring(d, 5, 2).try_cast("int").between(1, 12), F.substring(d, 7, 2).try_cast("int").between(1, 31)
        return ~((F.length(d) == 4) & year) & ~((F.length(d) == 8) & year & month & day)

    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    above = F.flatten(F.transform(folders, lambda f: F.slice(F.regexp_extract_all(f, F.lit(r"(\d{4,})"), 1), 1, 1)))
    own = [] if field is None else [F.when(F.trim(F.coalesce(field, F.lit(""))) != "", account_number(field))]
    return F.coalesce(*own, *[found(p) for p in EXACT_ACCOUNTS], *[account_number(found(p)) for p in ACCOUNT_PARTS], account_number(F.get(F.filter(runs, no_date), 0)), account_number(F.get(above, 0)), F.lit("unknown"))
