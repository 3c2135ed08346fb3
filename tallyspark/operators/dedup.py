"""Exact and fuzzy removal of duplicates: windows only, no self-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import stripped
from ..functions.text import signature_text
from .graph import materialise
from .hot import dealt_join
from .texts import with_text

GAP_DAYS = 3
#: Accounts that are broadcast, at most.
FEW = 500_000
SIGNATURE = ["abs_amount", "norm_description", "account_key"]


def exact(txns: DataFrame, per_file: bool = True) -> DataFrame:
    """The first row of each key: id and date if there is an id, else date, amount, description and account in lower case."""
    low = lambda c: F.lower(stripped(F.coalesce(F.col(c), F.lit(""))))
    has = stripped(F.coalesce(F.col("transaction_id"), F.lit(""))) != ""
    key = F.when(has, F.struct(F.lit("id").alias("k"), stripped(F.col("transaction_id")).alias("a"), F.col("date").alias("d"), F.lit(None).cast("decimal(18,2)").alias("m"), F.lit("").alias("b"))).otherwise(
        F.struct(F.lit("row").alias("k"), low("description").alias("a"), F.col("date").alias("d"), F.col("amount").alias("m"), low("account").alias("b"))
    )
    by = ["__key", *(["source_file"] if per_file else [])]
    return txns.withColumn("__key", key).withColumn("__nth", F.row_number().over(W.partitionBy(*by).orderBy("txn_seq"))).where("__nth = 1").drop("__key", "__nth")


def on_columns(txns: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The first row by date, amount, description (then input order) of each combination of the columns."""
    columns = columns or ["date", "amount", "description", "account", "institution"]
    nth = F.row_number().over(W.partitionBy(*columns).orderBy("date", "amount", "description", "txn_seq"))
    return txns.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def signed(txns: DataFrame) -> DataFrame:
    """With the three parts of the fuzzy signature: absolute amount, normal form of the description, account."""
    return txns.withColumns({"abs_amount": F.abs("amount").cast("decimal(18,2)"), "norm_description": signature_text(F.col("description")), "account_key": F.coalesce("account", F.lit(""))})


def clusters(txns: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """With cluster_no (from 0) and cluster_size: rows of a signature in order of date, a new cluster after a gap of more than
    gap_days between neighbours, so a cluster can span weeks."""
    by_date = W.partitionBy(*SIGNATURE).orderBy("date", "txn_seq")
    new = F.coalesce((F.datediff("date", F.lag("date").over(by_date)) > gap_days).cast("int"), F.lit(0))
    out = signed(txns).withColumn("__new", new).withColumn("cluster_no", F.sum("__new").over(by_date).cast("int")).drop("__new")
    return out.withColumn("cluster_size", F.count("*").over(W.partitionBy(*SIGNATURE, "cluster_no")))


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def fuzzy(txns: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """One row per cluster: the best (1000 for an id, 100 for a category, 50 for a balance, 25 for a longer description, its place in
    the cluster; the first of equals), gaps filled from the first row that has a value; with cluster_size."""
    columns = txns.columns
    c = clusters(txns, gap_days)
    group = W.partitionBy(*SIGNATURE, "cluster_no")
    by_date = group.orderBy("date", "txn_seq")
    fields = [x for x in ("date", "amount", "description", "account", "institution", "transaction_id", "category", "balance") if x in columns]
    pos = F.row_number().over(by_date) - 1
    # a row equal to an earlier one has that one's place
    c = c.withColumn("__pos", pos).withColumn("__place", F.min("__pos").over(W.partitionBy(*SIGNATURE, "cluster_no", *fields)))
    score = (
        F.when(_text("transaction_id").isNotNull(), 1000).otherwise(0) + F.when(_text("category").isNotNull(), 100).otherwise(0)
        + F.when(F.col("balance").isNotNull(), 50).otherwise(0) + F.when(F.length("description") > 10, 25).otherwise(0) + F.col("__place")
    )
    c = c.withColumn("__score", score).withColumn("__nth", F.row_number().over(group.orderBy(F.desc("__score"), "__pos")))
    every = by_date.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fill = {x: F.coalesce(_text(x), F.first(_text(x), ignorenulls=True).over(every)) for x in ("description", "transaction_id", "category")}
    fill["balance"] = F.coalesce("balance", F.first("balance", ignorenulls=True).over(every))
    filled = c.withColumns({f"__{k}": v for k, v in fill.items()}).where("__nth = 1")
    return filled.select(*[F.col(f"__{x}").alias(x) if x in fill else F.col(x) for x in columns], "cluster_size")


def signature_groups(txns: DataFrame) -> DataFrame:
    """Signatures of more than one row, without a test of dates: the three parts and group_size."""
    return signed(txns).groupBy(*SIGNATURE).agg(F.count("*").alias("group_size")).where("group_size > 1")


def statistics(txns: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """input_count, duplicate_groups, removed_count, final_count of the fuzzy removal."""
    per = clusters(txns, gap_days).groupBy(*SIGNATURE, "cluster_no").agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("input_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removed_count"), F.count("*").alias("final_count"),
    )


def cross_file(txns: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Rows of clusters that more than one file has, with n_files."""
    files = clusters(txns, gap_days).withColumn("n_files", F.size(F.collect_set("source_file").over(W.partitionBy(*SIGNATURE, "cluster_no"))).cast("long"))
    return files.where("n_files > 1").select("txn_seq", "source_file", *SIGNATURE, "cluster_no", "cluster_size", "n_files")


def mergeable_accounts(txns: DataFrame) -> DataFrame:
    """Accounts that more than one file has: account, institution (lower case), n_files."""
    return txns.groupBy("account", F.lower("institution").alias("institution")).agg(F.count_distinct("source_file").alias("n_files")).where("n_files > 1")


def merged_account(txns: DataFrame, account: str, institution: str) -> DataFrame:
    """Rows of one account over all files, fuzzily merged if more than one file has it; enrichment is kept."""
    own = txns.where((F.col("account") == account) & (F.lower("institution") == institution.lower()))
    several = own.agg((F.count_distinct("source_file") > 1).alias("several")).first()["several"]
    return (fuzzy(own).drop("cluster_size") if several else own).orderBy("date", "txn_seq")


def matches(a: str, b: str, days: int = GAP_DAYS) -> Column:
    """Whether rows with aliases a and b are the same transaction: by id if both have one, else near in date, equal in account,
    within a cent (signed), and equal or blank in description."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    ids = (F.coalesce(x("transaction_id"), F.lit("")) != "") & (F.coalesce(y("transaction_id"), F.lit("")) != "")
    dx, dy = signature_text(x("description")), signature_text(y("description"))
    near = (F.abs(F.datediff(x("date"), y("date"))) <= days) & (F.abs(x("amount") - y("amount")) <= 0.01) & (x("account") == y("account")) & ((dx == dy) | (dx == "") | (dy == ""))
    return F.when(ids, x("transaction_id") == y("transaction_id")).otherwise(near)


def matching_pairs(txns: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    """(seq_a, seq_b) of all rows, in input order, that `matches`: those of equal ids meet by id; others by account, cents, days and normal form of the description, rows
    without text with all."""
    has_id = F.coalesce("transaction_id", F.lit("")) != ""
    rows = materialise(with_text(txns.where("txn_seq is not null").select("txn_seq", "transaction_id", "date", "amount", "account", "description"), "description", "text", signature_text).drop("description").withColumn("has_id", has_id))
    ids = rows.where("has_id").select("transaction_id", "txn_seq")
    by_id = dealt_join(ids.withColumnRenamed("txn_seq", "seq_a"), ids.withColumnRenamed("txn_seq", "seq_b"), ["transaction_id"], "seq_a").where("seq_a < seq_b")

    keyed = rows.where("account is not null and date is not null and amount is not null").select(
        "account", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.floor(F.col("amount") * 100).cast("long").alias("cents"), "text", "has_id", "txn_seq", "amount"
    )
    place = {"account": F.col("account"), "days": F.floor(F.col("day") / (2 * days + 1)), "parts": F.floor(F.col("cents") / 4)}
    near = lambda c, n, width: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - n) / width), F.floor((F.col(c) + n) / width))))

    def met(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        """Rows a without id and rows b, by place: a row of a stands in each place where its partners are."""
        around = a.where("not has_id").withColumn("days", near("day", days, 2 * days + 1)).withColumn("parts", near("cents", 1, 4))
        left = around.select(*place, *more, F.col("txn_seq").alias("seq_a"), F.col("amount").alias("amount_a"), F.col("day").alias("day_a"))
        right = b.select(*[c.alias(name) for name, c in place.items()], *more, F.col("txn_seq").alias("seq_b"), F.col("amount").alias("amount_b"), F.col("day").alias("day_b"), F.col("has_id").alias("has_b"))
        return dealt_join(left, right, [*place, *more], "seq_a").where((F.abs(F.col("amount_a") - F.col("amount_b")) <= 0.01) & (F.abs(F.col("day_a") - F.col("day_b")) <= days))

    # of a pair, one row has no id: it is a; if both have none, the earlier one is
    out = [by_id, met(keyed, keyed, "text").where("has_b or seq_a < seq_b")]
    blank, texts = keyed.where("text = ''"), keyed.where("text <> ''")
    if not blank.isEmpty():
        out += [met(blank, texts), met(texts, blank.where("has_id"))]
    ends = [F.least("seq_a", "seq_b").alias("seq_a"), F.greatest("seq_a", "seq_b").alias("seq_b")]
    return reduce(DataFrame.union, [df.where("seq_a <> seq_b").select(*ends) for df in out])


def import_merged(txns: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """The importer's removal: fuzzy, then account names: a merged row takes the first enrichment of its institution and account in
    input order, others keep their own; the account and `debit` where there is none."""
    names = txns.groupBy(F.lower("institution").alias("__inst"), F.col("account").alias("__account")).agg(F.min_by(F.struct("account_name", "account_type"), "txn_seq").alias("__first"))
    names = materialise(names)
    names = F.broadcast(names) if names.count() <= FEW else names
    same = F.lower("institution").eqNullSafe(F.col("__inst")) & F.col("account").eqNullSafe(F.col("__account"))
    out = fuzzy(txns, gap_days).join(names, same, "left")
    merged = F.col("cluster_size") > 1
    pick = lambda c, other: F.coalesce(F.when(merged, F.col(f"__first.{c}")).otherwise(F.col(c)), other)
    return out.withColumns({"account_name": pick("account_name", F.col("account")), "account_type": pick("account_type", F.lit("debit"))}).select(*txns.columns)
