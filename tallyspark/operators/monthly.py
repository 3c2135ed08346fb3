"""Months and years by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import category
from ..functions.dates import month_key
from .graph import materialise
from .ranks import placed
from .transfers import card_payment_pairs, internal_transfer_pairs

BUCKETS = ["income", "internal_transfer", "external_transfer", "credits", "spending"]


def classified(txns: DataFrame) -> DataFrame:
    """With category and month."""
    return txns.withColumn("category_class", category(F.col("description"), F.col("amount"), F.col("account_type"))).withColumn("month", month_key(F.col("date")))


def _entries(txns: DataFrame) -> DataFrame:
    bucket = F.when(F.col("category_class") == "refund", "credits").otherwise(F.col("category_class"))
    return classified(txns).select("month", bucket.alias("bucket"), "amount", "txn_seq", F.lit(False).alias("is_pair"))


def rolled(entries: DataFrame) -> DataFrame:
    sums = {b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias(b) for b in BUCKETS}
    out = entries.withColumn("year", F.substring("month", 1, 4)).rollup("year", "month").agg(*sums.values(), F.grouping_id().cast("int").alias("level"))
    net = sum((F.col(b) for b in BUCKETS if b not in ("internal_transfer", "income")), F.col("income"))
    return out.select(F.col("year"), "month", *BUCKETS, net.cast("decimal(18,2)").alias("net"), "level")


def category_rollup(txns: DataFrame) -> DataFrame:
    """Sums of each month (level 0), year (1) and in total (3); net is without internal transfers."""
    return rolled(_entries(txns))


def net_of_pairs(txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are in no pair, as entries; and one entry per pair: the sent amount of a card payment, 0 of an internal transfer."""
    ends = [F.col("sent.txn_seq").alias("txn_seq"), F.col("received.txn_seq").alias("received"), month_key(F.col("sent.date")).alias("month")]
    card = card_payment_pairs(txns).select(*ends, F.col("sent.amount").alias("amount"))
    pairs = materialise(card.union(internal_transfer_pairs(txns).select(*ends, F.lit(0).cast("decimal(18,2)"))))
    used = pairs.select(F.explode(F.array("txn_seq", "received")).alias("txn_seq")).distinct()
    entries = pairs.select("month", F.lit("internal_transfer").alias("bucket"), "amount", "txn_seq", F.lit(True).alias("is_pair"))
    return _entries(txns.join(used, "txn_seq", "left_anti")), entries


def report(txns: DataFrame) -> DataFrame:
    """category_rollup with paired transfers taken together."""
    rows, pairs = net_of_pairs(txns)
    return rolled(rows.union(pairs))


DRILL = ["txn_seq", "date", "amount", "description", "account_name", "institution"]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with nth: the place in their month and bucket, by date, then the larger amount. Cells of any size are ranged over all tasks."""
    return placed(rows, ["month", "bucket"], [F.col("date"), F.desc(F.abs("amount")), F.col("txn_seq"), F.col("is_pair")], "nth")


def drill_rows(txns: DataFrame) -> DataFrame:
    """What the report adds up, flat: (month, bucket, nth, txn_seq, date, amount, description, account_name, institution, is_pair). Rows that
    are in no pair, and one flagged row per pair, with the sent row's date and texts. nth: the place in the cell."""
    rows, pairs = net_of_pairs(txns)
    about = txns.select("txn_seq", "date", "description", "account_name", "institution")
    return _placed(rows.union(pairs).join(about, "txn_seq")).select("month", "bucket", "nth", *DRILL, "is_pair")


def drill_down(txns: DataFrame) -> DataFrame:
    """Rows of each month and bucket, pairs apart, flat: (month, bucket, nth, txn_seq, date, amount, description, account_name, institution)."""
    bucket = F.when(F.col("category_class") == "refund", "credits").otherwise(F.col("category_class"))
    return _placed(classified(txns).select("month", bucket.alias("bucket"), *DRILL, F.lit(False).alias("is_pair"))).select("month", "bucket", "nth", *DRILL)
