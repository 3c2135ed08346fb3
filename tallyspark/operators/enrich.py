"""Account names by a look-up on institution and account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accounts that are broadcast at most.
BROADCAST_ACCOUNTS = 100_000


def enriched(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """txns with account_name and account_type from accounts (institution in lower case, account_id, account_name, account_type);
    else the account itself and `debit`."""
    dim = accounts.select(F.col("institution").alias("__inst"), F.col("account_id").alias("__id"), F.col("account_name").alias("__name"), F.col("account_type").alias("__type"))
    dim = F.broadcast(dim) if dim.limit(BROADCAST_ACCOUNTS + 1).count() <= BROADCAST_ACCOUNTS else dim
    both = txns.drop("account_name", "account_type").join(dim, (F.lower("institution") == F.col("__inst")) & (F.col("account") == F.col("__id")), "left")
    return both.withColumn("account_name", F.coalesce("__name", "account")).withColumn("account_type", F.coalesce("__type", F.lit("debit"))).drop("__inst", "__id", "__name", "__type")
