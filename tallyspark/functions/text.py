"""Descriptions as Column expressions: cleaning, normal forms, similarity, keyword classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import cents_text
from .dates import stripped

# Prefixes that are taken off a description, one after the other, each once, in any case.
PREFIXES = ["DEBIT", "CREDIT", "ACH", "POS", "ATM", "CHECK", "CHECKCARD", "VISA", "MASTERCARD", "AMEX"]
# What is taken off the end of a description or replaced in it afterwards, in order.
NOISE = [
    (r"(?i)\s+(REF|TXN|TRACE|AUTH)#?\s*[A-Z0-9]+\s*$", ""),
    (r"\s+\d{2}/\d{2}/\d{4}\s*$", ""),
    (r"\s+\d{4}-\d{2}-\d{2}\s*$", ""),
    (r"[*]{2,}", " "),
    (r"[-]{2,}", " "),
    (r"[.]{2,}", " "),
    (r"\s+#\d+\s+[A-Z]{2,}\s+[A-Z]{2}\s*$", ""),
    (r"\s+[A-Z]{2,}\s+[A-Z]{2}\s+\d{5}\s*$", ""),
]
# Replacements of the normal form in signatures, in order, on lower case.
SIGNATURE_RULES = [
    (r"\s+\d{2,}\s*$", ""),
    (r"\s+#\d+", ""),
    (r"\*[0-9]+", ""),
    (r"\s+amzn\.com/bill\s+wa\s*$", ""),
    (r"\s+&\s+", " and "),
    (r"\s+llc\s*$", ""),
    (r"\s+inc\s*$", ""),
    (r"\s+co\s*$", ""),
    (r"\s+[a-z]+\s+wa\s*$", ""),
    (r"\s+[a-z]+\s+[a-z]{2}\s*$", ""),
    (r"tst\*", ""),
    (r"sq \*", ""),
    (r"amazon\.com\*", "amazon "),
    (r"amazon mktpl\*", "amazon "),
]
# Prefixes of merchants' names for the search of duplicates, and the shorter list for PDF and QFX pairs.
MERCHANT_PREFIXES = ["tst* ", "sq *", "sp *", "pos ", "debit ", "credit ", "purchase ", "sale ", "payment ", "withdrawal ", "deposit "]
PAIR_PREFIXES = ["tst* ", "sq *", "sp *", "pos ", "debit ", "credit "]
MERCHANT_RULES = [(r"#\d+", ""), (r"\s+\d+\s+[nsew]{1,2}\s+\w+", "")]
PAIR_RULES = [(r"#\d+", ""), (r"\s+\d+\s+[nsew]{1,2}\s+\w+.*$", ""), (r"\s+[a-z]+\s+wa\s*$", ""), (r"\s+\(\s*\d*\s*$", "")]

# Keywords of transactions for the detection of sign conventions.
TRANSFER_OUT = ["transfer to", "transfer out", "outgoing transfer", "wire out", "send", "transfer debit"]
TRANSFER_IN = ["transfer from", "transfer in", "incoming transfer", "wire in", "receive", "transfer credit", "deposit from"]
CARD_PAYMENTS = ["credit crd epay", "credit card epay", "cardpymt", "card payment", "gsbank payment", "applecard gsbank", "chase credit", "discover payment"]
INCOME = ["deposit", "credit", "refund", "return", "cashback", "reward", "rebate", "salary", "payroll", "dividend", "interest earned", "bonus", "transfer in", "incoming", "received", "thank you", "adjustment credit", "reversal"]
SPENDING = [
    "purchase", "fee", "interest", "charge", "penalty", "late", "withdrawal", "atm", "pos", "debit", "bill", "subscription", "grocery", "restaurant", "gas", "fuel",
    "shopping", "store", "market", "pharmacy", "medical", "insurance", "rent", "mortgage", "loan", "tax", "fine",
]


def replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, "(?U)" + rule[0], rule[1]), rules, c)


def collapsed(c: Column) -> Column:
    """White space (of Unicode too) to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def literal(words: list[str]) -> str:
    """A pattern that finds any of the words."""
    return "|".join("".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in w) for w in words)


def has_any(c: Column, words: list[str]) -> Column:
    return c.rlike(literal(words))


def clean_description(c: Column) -> Column:
    """Without prefixes and trailing references, dates and places; the stripped text if nothing is left; empty for null."""
    s = stripped(F.coalesce(c, F.lit("")))
    rules = [(rf"(?i)^{p}\s+", "") for p in PREFIXES] + NOISE
    out = collapsed(replaced(collapsed(s), rules))
    return F.when(out == "", s).otherwise(out)


def signature_text(c: Column) -> Column:
    return collapsed(replaced(stripped(F.lower(F.coalesce(c, F.lit("")))), SIGNATURE_RULES))


def _without_prefixes(c: Column, prefixes: list[str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "^" + literal([p]) + r"(?U)\s*", ""), prefixes, c)


def merchant_name(c: Column) -> Column:
    return collapsed(replaced(_without_prefixes(stripped(F.lower(c)), MERCHANT_PREFIXES), MERCHANT_RULES))


def pair_merchant_name(c: Column) -> Column:
    return collapsed(replaced(_without_prefixes(stripped(F.lower(F.coalesce(c, F.lit("")))), PAIR_PREFIXES), PAIR_RULES))


def builder_text(c: Column) -> Column:
    """The cleaning of the total builder: store numbers, and a word before a final `wa`."""
    return stripped(F.regexp_replace(stripped(F.lower(c)), r"(?U)#\d+|\s+\w+\s+wa\s*$", ""))


def word_set(c: Column) -> Column:
    """Distinct words; none of a blank text."""
    return F.array_remove(F.array_distinct(F.split(collapsed(c), " ")), "")


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty. Joins compute the sets before they pair rows."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(word_set(a), word_set(b))


def signature(transaction_id: Column, amount: Column, description: Column, account: Column, ignore_id: bool = False) -> Column:
    """id:<id>, or sig: and 12 hexadecimal digits of amount, description and account. Operators group by the three themselves."""
    joined = F.concat_ws("|", cents_text(F.abs(amount)), signature_text(description), F.coalesce(account, F.lit("")))
    sig = F.concat(F.lit("sig:"), F.substring(F.md5(joined), 1, 12))
    return sig if ignore_id else F.when(F.coalesce(transaction_id, F.lit("")) != "", F.concat(F.lit("id:"), transaction_id)).otherwise(sig)


def transaction_type(description: Column) -> Column:
    """transfer_out, transfer_in, income, spending or unknown; spending words of up to three letters stand alone."""
    d = F.lower(F.coalesce(description, F.lit("")))
    short = r"\b(" + "|".join(w for w in SPENDING if len(w) <= 3) + r")\b"
    return (
        F.when(has_any(d, TRANSFER_OUT), "transfer_out")
        .when(has_any(d, TRANSFER_IN), "transfer_in")
        .when(has_any(d, CARD_PAYMENTS), "transfer_out")
        .when(has_any(d, INCOME), "income")
        .when(d.rlike(short) | has_any(d, [w for w in SPENDING if len(w) > 3]), "spending")
        .otherwise("unknown")
    )
