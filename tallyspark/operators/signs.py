"""Sign conventions: statistics per file, the decision, the correction of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_any, transaction_type

# Words of card statements.
STATEMENT_CREDITS = ["payment", "thank you", "refund", "return", "credit", "adjustment", "cashback", "reward", "rebate", "amazon.com amzn.com/bill"]
STATEMENT_DEBITS = ["purchase", "fee", "interest", "charge", "penalty", "late", "amazon.com*", "amazon mktpl*"]
FLIP_CONFIDENCE = 0.5


def statistics(txns: DataFrame, by: str = "source_file") -> DataFrame:
    """Counts and shares of positive amounts of spending and income rows of each file; a share of nothing is 0."""
    kind, positive = transaction_type(F.col("description")), F.col("amount") > 0
    out = txns.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(kind == "spending").alias("spending_count"), F.count_if((kind == "spending") & positive).alias("spending_positive"),
        F.count_if(kind == "income").alias("income_count"), F.count_if((kind == "income") & positive).alias("income_positive"),
    )
    share = lambda k: F.coalesce(F.try_divide(F.col(f"{k}_positive"), F.col(f"{k}_count")), F.lit(0.0))
    return out.withColumn("spending_ratio", share("spending")).withColumn("income_ratio", share("income"))


def convention(spending_ratio: Column, income_ratio: Column, spending: Column, income: Column) -> tuple[Column, Column]:
    """Name and confidence. Both ratios weigh only with three rows or more."""
    n, s, i = spending + income, spending_ratio, income_ratio
    enough = (spending >= 2) & (income >= 1)
    strong, mild = F.least(F.lit(0.9), 0.4 + n / 15), F.least(F.lit(0.7), 0.3 + n / 20)
    cases = [
        (n < 3, "unknown", F.lit(0.0)),
        (enough & (s <= 0.2) & (i >= 0.8), "banking", strong),
        (enough & (s >= 0.8) & (i <= 0.2), "credit_card", strong),
        ((s <= 0.3) & (i >= 0.6), "banking", mild),
        ((s >= 0.7) & (i <= 0.4), "credit_card", mild),
        ((F.abs(s - 0.5) < 0.3) | (F.abs(i - 0.5) < 0.3), "mixed", F.lit(0.2)),
    ]
    name, confidence = F.lit("unknown"), F.lit(0.1)
    for when, label, value in reversed(cases):
        name, confidence = F.when(when, label).otherwise(name), F.when(when, value).otherwise(confidence)
    return name, confidence


def decisions(txns: DataFrame, by: str = "source_file") -> DataFrame:
    """statistics with convention, confidence and flip: whether the file's signs are those of a card statement."""
    s = statistics(txns, by)
    name, confidence = convention(F.col("spending_ratio"), F.col("income_ratio"), F.col("spending_count"), F.col("income_count"))
    out = s.withColumn("convention", name).withColumn("confidence", confidence)
    return out.withColumn("flip", (F.col("convention") == "credit_card") & (F.col("confidence") >= FLIP_CONFIDENCE))


def corrected(txns: DataFrame, by: str = "source_file") -> DataFrame:
    """txns with the amounts of flipped files negated, all rows of a file or none; balances stay."""
    flip = decisions(txns, by).where("flip").select(by, F.lit(True).alias("__flip"))
    return txns.join(flip, by, "left").withColumn("amount", F.when(F.col("__flip"), -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)")).select(txns.columns)


def statement_sign(amount: Column, description: Column) -> Column:
    """Banking sign of an amount on a card statement: credit words, then debit words, then the sign turned round."""
    d = F.lower(F.coalesce(description, F.lit("")))
    return F.when(has_any(d, STATEMENT_CREDITS), F.abs(amount)).when(has_any(d, STATEMENT_DEBITS), -F.abs(amount)).otherwise(-amount)
