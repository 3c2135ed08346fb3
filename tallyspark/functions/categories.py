"""The category of a transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_any

# Patterns by category, all parts of the lower-case description.
INTERNAL = ["transfer to ", "transfer from ", "to pocket", "from pocket", "deposit transfer from", "withdrawal transfer to"]
CARD_PAYMENT = ["payment thank you", "payment received", "payment transaction", "cardpymt", "applecard gsbank payment", "gsbank payment"]
EXTERNAL = ["olb external transfer", "external transfer"]
CARD_TRANSFER = ["payment transaction", "deposit internet transfer", "transfer"]
INCOME = ["deposit moodys analytics", "deposit moodys investor", "deposit risk management", "deposit microsoft", "deposit payroll", "deposit real property", "dividend", "deposit paid leave"]
CATEGORIES = ["income", "internal_transfer", "external_transfer", "refund", "spending"]


def category(description: Column, amount: Column, account_type: Column) -> Column:
    """The first that fits: internal transfer, card payment (internal too), external transfer, on cards transfer words then the
    sign, else negative amounts as spending, income, refund."""
    d = F.lower(F.coalesce(description, F.lit("")))
    card = F.coalesce(account_type, F.lit("")) == "credit"
    return (
        F.when(has_any(d, INTERNAL) | has_any(d, CARD_PAYMENT), "internal_transfer")
        .when(has_any(d, EXTERNAL), "external_transfer")
        .when(card & has_any(d, CARD_TRANSFER), "internal_transfer")
        .when(amount < 0, "spending")
        .when(~card & has_any(d, INCOME), "income")
        .otherwise("refund")
    )
