"""Transfers between accounts: pairs by lag, card payments, internal transfers, timing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.amounts import tolerance_score
from ..functions.dates import business_days, days_apart, month_key
from ..functions.text import has_any, literal
from .graph import materialise
from .hot import dealt_join
from .matching import EqualParts, NearAmounts, matched, ranked_days
from .ranks import placed

# Parts of institutions and descriptions on both sides of a card payment, and of internal transfers.
CARD_RECEIVED = [("chase", "payment thank you"), ("gemini", "payment transaction"), ("apple", "deposit internet transfer fr")]
CARD_SENT = [("firsttech", "applecard gsbank payment"), ("firsttech", "chase credit crd epay"), ("discover", "gemini cardpymt")]
TRANSFER_SENT = ["withdrawal transfer to", "transfer to", "outgoing transfer", "wire out", "descriptive withdrawal p2p transfer", "p2p transfer", "zelle sent", "zelle payment to"]
TRANSFER_RECEIVED = ["deposit transfer from", "transfer from", "incoming transfer", "wire in", "zelle payment from", "zelle received", "zelle deposit"]
TRANSFER_WORDS = [
    "transfer to ", "transfer from ", "to pocket", "from pocket", "deposit transfer from", "withdrawal transfer to", "payment thank you", "payment received",
    "payment transaction", "cardpymt", "applecard gsbank payment", "gsbank payment", "chase credit crd epay", "gemini cardpymt", "discover payment",
]
PAYMENT_WORDS = ["payment", "pymt", "cardpymt", "thank you"]
FIELDS = ["txn_seq", "date", "amount", "description", "account", "institution"]


def _row(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in FIELDS])


def _days_near(most: int) -> Column:
    """The days at most `most` business days from date, as an array of (day, lag)."""
    span = most + 2 * (most // 5 + 1)  # a lag of n business days spans at most so many calendar days
    around = F.transform(F.sequence(F.lit(-span), F.lit(span)), lambda k: F.date_add("date", k))
    return F.filter(F.transform(around, lambda d: F.struct(d.alias("day"), business_days(F.col("date"), d).alias("lag"))), lambda x: x["lag"] <= most)


def _out(rows: DataFrame, most: int) -> DataFrame:
    """Rows of negative amount, each at every day (with its lag) where a partner can be."""
    return rows.where("amount < 0").withColumn("__x", F.explode(_days_near(most))).select("*", F.abs("amount").cast("decimal(18,2)").alias("abs_amount"), "__x.day", "__x.lag").drop("__x")


def _into(rows: DataFrame) -> DataFrame:
    return rows.where("amount > 0").withColumns({"abs_amount": F.abs("amount").cast("decimal(18,2)"), "day": F.col("date")})


def _met(out: DataFrame, into: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs (abs_amount, lag, o_..., i_...) of `_out` and `_into`; a row is no pair with itself."""
    named = lambda df, prefix, *more: df.select("abs_amount", "day", *more, *[F.col(c).alias(prefix + c) for c in FIELDS])
    return join(named(out, "o_", "lag"), named(into, "i_")).where("o_txn_seq <> i_txn_seq")


def _lagged(txns: DataFrame, most: int) -> DataFrame:
    """Pairs of equal absolute amount, opposite sign and at most `most` business days: the row of negative amount (o_...), the other (i_...), lag.

    The amount alone is a skewed key, and quadratic; the one side stands at each day where a partner can be, and rows meet by amount and
    day, so that little but pairs is joined."""
    rows = materialise(txns.select(*FIELDS))
    return _met(_out(rows, most), _into(rows), lambda a, b: dealt_join(a, b, ["abs_amount", "day"], "o_txn_seq"))


#: Whether the rows of a pair are of two accounts.
APART = "o_institution <> i_institution or o_account <> i_account"


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.where(APART).select("abs_amount", _row("o_").alias("source"), _row("i_").alias("dest"), "lag")


def transfer_pairs(txns: DataFrame, most: int = 3) -> DataFrame:
    """(abs_amount, source, dest, lag): all pairs but those within one account; a row can be in several."""
    return _ends(_lagged(txns, most))


def potential_transfers(txns: DataFrame, most: int = 3) -> DataFrame:
    """(abs_amount, first, second, lag): also within one account; first is the one with the earlier date, or the earlier row."""
    early = F.expr("o_date < i_date or o_date = i_date and o_txn_seq < i_txn_seq")
    end = lambda a, b: F.struct(*[F.when(early, F.col(a + c)).otherwise(F.col(b + c)).alias(c) for c in FIELDS])
    return _lagged(txns, most).select("abs_amount", end("o_", "i_").alias("first"), end("i_", "o_").alias("second"), "lag")


def _partners(rows: DataFrame, most: int, owners: bool) -> DataFrame:
    """The partners of `transfer_pairs` in numbers: (abs_amount, date, institution, account, day, lag, n, partners): n rows of negative amount, and how many partners each
    has on a day: all rows of the day (of all accounts together unless owners), then with a minus those of the same account. Its work grows with the groups of equal
    rows, never with the pairs.

    Where institution or account is null, it tells no rows apart: groups are of one account if they agree in what both have."""
    groups = materialise(rows.where("amount <> 0").groupBy("amount", "date", "institution", "account").agg(F.count("*").alias("n")))
    lack = F.col("institution").isNull().cast("int") + F.col("account").isNull().cast("int") * 2
    lacks = [r[0] for r in groups.select(lack).distinct().collect()] or [0]  # four at most

    def known(df: DataFrame, own: str, other: str) -> DataFrame:
        each = df.withColumn(own, lack).withColumn(other, F.explode(F.array(*map(F.lit, lacks))))
        has = lambda c, bit: F.when((F.col(own).bitwiseOR(F.col(other))).bitwiseAND(F.lit(bit)) == 0, F.col(c)).alias(f"of_{c}")
        return each.select("*", has("institution", 1), has("account", 2))

    out, into = _out(groups, most), _into(groups)
    by, keys = ["abs_amount", "date", "institution", "account", "day", "lag", "n"], ["abs_amount", "day", "lack_o", "lack_i", "of_institution", "of_account"]
    same = known(into, "lack_i", "lack_o").groupBy(*keys).agg(F.sum("n").alias("same")).withColumnsRenamed({k: f"__{k}" for k in keys})
    less = known(out, "lack_o", "lack_i").join(same, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*by, (-F.col("same")).alias("partners"))
    if not owners:
        nobody = [F.lit(None).cast("string").alias(c) for c in ("institution", "account")]
        out = _out(groups.groupBy("amount", "date").agg(F.sum("n").alias("n")).select("*", *nobody), most)
    return out.join(into.groupBy("abs_amount", "day").agg(F.sum("n").alias("partners")), ["abs_amount", "day"]).select(*by, "partners").union(less)


def _numbered_alike(rows: DataFrame, most: int) -> DataFrame | None:
    """What `_partners` counts though both rows have one number, which is no pair; None where no number has rows of both signs."""
    both = materialise(rows.groupBy("txn_seq").agg(F.min("amount").alias("low"), F.max("amount").alias("high")).where("low < 0 and high > 0").select("txn_seq"))
    if both.isEmpty():
        return None
    some = materialise(rows.join(both, "txn_seq", "left_semi"))
    named = _into(some).select("abs_amount", "day", *[F.col(c).alias(f"i_{c}") for c in ("txn_seq", "institution", "account")])
    met = _out(some, most).join(named.withColumn("txn_seq", F.col("i_txn_seq")), ["abs_amount", "day", "txn_seq"])
    return met.where("institution <> i_institution or account <> i_account")


def _rows(txns: DataFrame, fields: list[str]) -> DataFrame:
    return materialise(txns.where("txn_seq is not null and date is not null and amount is not null").select(*fields))


def pair_counts(txns: DataFrame, most: int = 3) -> DataFrame:
    """How many `transfer_pairs` there are: (abs_amount, source_date, dest_date, lag, pairs)."""
    rows = _rows(txns, [c for c in FIELDS if c != "description"])
    by = ["abs_amount", F.col("date").alias("source_date"), F.col("day").alias("dest_date"), "lag"]
    counted = _partners(rows, most, False).select(*by, (F.col("n") * F.col("partners")).alias("pairs"))
    alike = _numbered_alike(rows, most)
    counted = counted if alike is None else counted.union(alike.select(*by, F.lit(-1).cast("long")))
    return materialise(counted.groupBy("abs_amount", "source_date", "dest_date", "lag").agg(F.sum("pairs").alias("pairs")).where("pairs > 0"))


def rows_by_day(counts: DataFrame) -> DataFrame:
    """How many rows `pairs_by_day` lists: (date, abs_amount, rows), of pair_counts."""
    return counts.groupBy(F.least("source_date", "dest_date").alias("date"), "abs_amount").agg((2 * F.sum("pairs")).alias("rows"))


def pairs_by_day(pairs: DataFrame) -> DataFrame:
    """The rows of pairs by the earlier date and the amount, flat: (date, abs_amount, nth, side, and the row's fields), by number, sources first."""
    day = F.least("source.date", "dest.date")
    each = pairs.select(day.alias("day"), "abs_amount", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(side).alias("row"), F.col("dest.txn_seq").alias("other")) for k, side in enumerate(("source", "dest"))])).alias("x"))
    flat = each.select("day", "abs_amount", "x.side", "x.row", F.col("x.other").alias("other"))
    found = placed(flat, ["day", "abs_amount"], [F.col("row.txn_seq"), F.col("side"), F.col("other")], "nth")
    return found.select(F.col("day").alias("date"), "abs_amount", "nth", F.when(F.col("side") == 0, "source").otherwise("dest").alias("side"), "row")


def _any_side(rules: list[tuple[str, str]]) -> Column:
    inst, desc = F.lower("institution"), F.lower("description")
    out = F.lit(False)
    for i, d in rules:
        out = out | (inst.contains(i) & desc.contains(d))
    return out


def _sides(asking: DataFrame, partners: DataFrame, by_amount: bool, owner: Column) -> DataFrame:
    """Rows for `matched` from two sets of transactions; rows without date or amount can't be in a pair."""
    cents = F.abs(F.col("amount") * 100).cast("long")
    part = cents if by_amount else F.lit(0).cast("long")
    row = lambda df, asks: df.where("date is not null and amount is not null").select(
        part.alias("part"), F.lit(asks).alias("asks"), F.col("txn_seq").alias("seq"), F.datediff("date", F.lit("1970-01-01")).alias("day"), cents.alias("cents"), owner.alias("owner")
    )
    return row(asking, True).union(row(partners, False))


def _with_rows(pairs: DataFrame, asking: DataFrame, partners: DataFrame, names: tuple[str, str]) -> DataFrame:
    """pairs (a, b) of numbers with their rows as structs."""
    a, b = (df.select(F.col("txn_seq").alias(k), _row().alias(name)) for df, k, name in ((asking, "a", names[0]), (partners, "b", names[1])))
    return pairs.join(a, "a").join(b, "b").select(*names)


def card_payment_pairs(txns: DataFrame, most: int = 7) -> DataFrame:
    """(sent, received, days): every received payment, in input order, takes the free sent one with the lowest score (days apart, more
    for amounts that differ by up to 10 %; the earlier of equals)."""
    received = txns.where(_any_side(CARD_RECEIVED) & (F.col("amount") > 0))
    sent = txns.where(_any_side(CARD_SENT) & (F.col("amount") < 0))
    pairs = matched(_sides(received, sent, False, F.lit("")), most, lambda *rows: NearAmounts(*rows, most=most))
    return _with_rows(pairs, received, sent, ("received", "sent")).select("sent", "received", days_apart(F.col("received.date"), F.col("sent.date")).alias("days"))


def internal_transfer_pairs(txns: DataFrame, most: int = 3) -> DataFrame:
    """(sent, received, days): every withdrawal, in input order, takes the nearest free deposit of the same amount in another account
    (the earlier of equals)."""
    sent = txns.where(has_any(F.lower("description"), TRANSFER_SENT) & (F.col("amount") < 0))
    received = txns.where(has_any(F.lower("description"), TRANSFER_RECEIVED) & (F.col("amount") > 0))
    account = F.coalesce("account", F.lit(""))
    pairs = matched(_sides(sent, received, True, account), most, lambda *rows: EqualParts(*rows, days=ranked_days(most, lambda d, e: abs(d - e))))
    return _with_rows(pairs, sent, received, ("sent", "received")).select("sent", "received", days_apart(F.col("sent.date"), F.col("received.date")).alias("days"))


def transfer_rows(txns: DataFrame) -> DataFrame:
    return txns.where(F.lower("description").rlike(literal(TRANSFER_WORDS)))


def _without(txns: DataFrame, pairs: DataFrame, ends: tuple[str, str]) -> DataFrame:
    used = pairs.select(F.explode(F.array(*[F.col(f"{e}.txn_seq") for e in ends])).alias("txn_seq")).distinct()
    return txns.join(used, "txn_seq", "left_anti")


def _lag(d: int, e: int) -> int:
    """Business days between two days since 1970 (a Thursday), both included."""
    until = lambda n: (n - 4) // 7 * 5 + min((n - 4) % 7 + 1, 5)
    return until(max(d, e)) - until(min(d, e) - 1)


def timing_pairs(txns: DataFrame, most: int = 3, card: DataFrame | None = None) -> DataFrame:
    """(abs_amount, source, dest, lag): among transfer rows that are in no card payment, every free row in input order takes the first
    later free one of the same amount, opposite sign and another account within `most` business days.

    That is a matching of withdrawals with deposits in which both sides prefer rows by input order."""
    card = card_payment_pairs(txns) if card is None else card
    rows = _without(transfer_rows(txns), card, ("sent", "received"))
    out, into = rows.where("amount < 0"), rows.where("amount > 0")
    owner = F.to_json(F.array(F.coalesce("institution", F.lit("")), F.coalesce("account", F.lit(""))))
    span = most + 2 * (most // 5 + 1)  # a lag of n business days spans at most so many calendar days
    pairs = matched(_sides(out, into, True, owner), span, lambda *sides: EqualParts(*sides, days=ranked_days(span, lambda d, e: 0 if _lag(d, e) <= most else None)))
    found = _with_rows(pairs, out, into, ("source", "dest"))
    return found.select(F.abs("source.amount").cast("decimal(18,2)").alias("abs_amount"), "source", "dest", business_days(F.col("source.date"), F.col("dest.date")).alias("lag"))


def unmatched_transfers(txns: DataFrame, most: int = 3) -> DataFrame:
    """Transfer rows that are in no card payment and no timing pair."""
    card = materialise(card_payment_pairs(txns))
    return _without(_without(transfer_rows(txns), card, ("sent", "received")), timing_pairs(txns, most, card), ("source", "dest"))


def match_rate(txns: DataFrame, most: int = 3) -> DataFrame:
    """transfers, matched (rows in pairs of either kind), rate (null without transfers)."""
    card = materialise(card_payment_pairs(txns))
    n = [df.agg(F.count("*").alias("n")) for df in (transfer_rows(txns), card, timing_pairs(txns, most, card))]
    one = n[0].select(F.col("n").alias("transfers"), F.lit(1).alias("k")).join(n[1].select(F.col("n").alias("c"), F.lit(1).alias("k")), "k").join(n[2].select(F.col("n").alias("t"), F.lit(1).alias("k")), "k")
    return one.select("transfers", (2 * (F.col("c") + F.col("t"))).alias("matched"), F.round(F.try_divide(2 * (F.col("c") + F.col("t")), F.col("transfers")), 6).alias("rate"))


def lag_distribution(counts: DataFrame) -> DataFrame:
    """pairs and share of all, by lag, of pair_counts. The total is taken over the few lags."""
    by = counts.groupBy("lag").agg(F.sum("pairs").alias("pairs"))
    return by.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(W.partitionBy()), 6)).orderBy("lag")


def totals_by_amount(counts: DataFrame) -> DataFrame:
    """pairs and their summed amount, by amount, largest first, of pair_counts."""
    by = counts.groupBy("abs_amount").agg(F.sum("pairs").alias("pairs"))
    return by.withColumn("total", (F.col("abs_amount") * F.col("pairs")).cast("decimal(18,2)")).orderBy(F.desc("abs_amount"))


def cross_month_impact(pairs: DataFrame) -> DataFrame:
    """Of pairs whose ends lie in different months: amounts that leave in one and arrive in the other, by month."""
    amount = F.col("abs_amount")
    zero = F.lit(0).cast("decimal(18,2)")
    out, into = month_key(F.col("source.date")), month_key(F.col("dest.date"))
    each = pairs.where(out != into).select(
        F.explode(
            F.array(
                F.struct(out.alias("month"), amount.alias("o"), zero.alias("i"), F.lit(1).alias("n")),
                F.struct(into.alias("month"), zero.alias("o"), amount.alias("i"), F.lit(0).alias("n")),
            )
        ).alias("x")
    )
    money = lambda c: F.sum(c).cast("decimal(18,2)")
    return each.groupBy("x.month").agg(money("x.o").alias("outgoing_this_month"), money("x.i").alias("incoming_next_month"), money(F.col("x.i") - F.col("x.o")).alias("net_impact"), F.sum("x.n").cast("long").alias("count"))


def unmatched_by_month(unmatched: DataFrame, top: int = 3) -> DataFrame:
    """Rows of the `top` largest unmatched transfers of each month, with the month's count and sum."""
    rows = unmatched.withColumn("month", month_key(F.col("date"))).withColumn("abs_amount", F.abs("amount").cast("decimal(18,2)"))
    nth = F.row_number().over(W.partitionBy("month").orderBy(F.desc("abs_amount"), "txn_seq"))
    best = rows.withColumn("rank", nth).where(F.col("rank") <= top).select("month", "rank", "txn_seq", "abs_amount")
    sums = rows.groupBy("month").agg(F.count("*").alias("count"), F.sum("abs_amount").cast("decimal(18,2)").alias("total"))
    return best.join(sums, "month")


def payment_label() -> Column:
    d = F.lower("description")
    return F.when(d.contains("thank you"), "Payment Thank You").when(d.contains("cardpymt"), "CardPymt (withdrawal)").when(d.contains("payment transaction"), "Payment Transaction").otherwise("Other Payment")


def payment_patterns(txns: DataFrame, first: int = 5) -> DataFrame:
    """The first rows of each kind of payment, in input order, with the kind's count."""
    rows = txns.where(has_any(F.lower("description"), PAYMENT_WORDS)).withColumn("label", payment_label())
    nth = F.row_number().over(W.partitionBy("label").orderBy("txn_seq"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= first).select("label", "rank", "txn_seq").join(rows.groupBy("label").agg(F.count("*").alias("count")), "label")


def recent_pairs(txns: DataFrame, n: int = 5, most: int = 3) -> DataFrame:
    """The `transfer_pairs` whose source is the latest.

    Sources that have a partner are found by `_partners`; only the n latest of them are joined with their partners."""
    rows = _rows(txns, FIELDS)
    alike = _numbered_alike(rows, most)
    own = ["abs_amount", "date", "institution", "account"]
    found = _partners(rows, most, True).groupBy(*own).agg(F.sum("partners").alias("partners")).where("partners > 0").withColumnsRenamed({c: f"__{c}" for c in own})
    sources = rows.where("amount < 0").withColumn("abs_amount", F.abs("amount").cast("decimal(18,2)"))
    sources = sources.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own])
    if alike is not None:
        given = [*own, "txn_seq"]
        lost = alike.groupBy(*given, "i_txn_seq").agg(F.count("*").alias("lost")).select(*[F.col(c).alias(f"-{c}") for c in given], "lost")
        sources = sources.join(lost, [F.col(c).eqNullSafe(F.col(f"-{c}")) for c in given], "left").where("partners > coalesce(lost, 0)")
    latest = materialise(sources.orderBy(F.desc("date"), F.desc("txn_seq")).limit(n).select(*FIELDS))
    pairs = _ends(_met(_out(latest, most), _into(rows), lambda a, b: b.join(F.broadcast(a), ["abs_amount", "day"])))
    return pairs.orderBy(F.desc("source.date"), F.desc("source.txn_seq"), F.desc("dest.txn_seq")).limit(n)
