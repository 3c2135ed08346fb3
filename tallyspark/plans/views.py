"""Transactions derived from the star-schema tables: one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Descriptions (SQL; k is the number in an event's props) and the sign of their amounts.
TEMPLATES = [
    ("'STARBUCKS STORE #' || k || ' SEATTLE WA'", -1), ("'AMAZON MKTPL*NV46R2L51 Amzn.com/bill WA'", -1), ("'DEBIT POS SAFEWAY GROCERY REF#12345'", -1), ("'Payment Thank You - Web'", 1),
    ("'PAYMENT TRANSACTION'", 1), ("'DEPOSIT INTERNET TRANSFER FR 1234'", 1), ("'APPLECARD GSBANK PAYMENT'", -1), ("'CHASE CREDIT CRD EPAY'", -1),
    ("'GEMINI CARDPYMT'", -1), ("'Withdrawal Transfer To Savings'", -1), ("'Deposit Transfer From Checking'", 1), ("'OLB EXTERNAL TRANSFER'", -1),
    ("'DEPOSIT PAYROLL ACME'", 1), ("'DIVIDEND INTEREST EARNED'", 1), ("'SQ *COFFEE HOUSE ' || k", -1), ("'TST* MERCURYS COFFEE #0658 BELLEVUE WA'", -1),
    ("'Zelle payment from A'", 1), ("'ZELLE SENT RENT'", -1), ("'SHELL GAS STATION 975 NW GILMAN'", -1), ("'REFUND AMAZON.COM*4K2'", 1),
    ("'ATM FEE'", -1), ("'A & B LLC'", -1), ("'NETFLIX SUBSCRIPTION'", -1), ("'To Pocket Vacation'", -1),
]
_description = "case t " + " ".join(f"when {i} then {d}" for i, (d, _) in enumerate(TEMPLATES)) + " end"
_sign = f"case when t in ({', '.join(str(i) for i, (_, s) in enumerate(TEMPLATES) if s > 0)}) then 1 else -1 end"

#: One month of transactions with many equal amounts, from events.
EVENTS = f"""
select event_id as txn_seq,
  case event_id % 3 when 0 then 'data/a/f' || cast(event_id % 7 as string) || '.pdf.csv' when 1 then 'data/a/f' || cast(event_id % 7 as string) || '.qfx.csv' else 'data/b/f' || cast(event_id % 5 as string) || '.csv' end as source_file,
  cast(ts as date) as date,
  cast(cast({_sign} * tenths as decimal(10,0)) * cast('0.10' as decimal(3,2)) as decimal(18,2)) as amount,
  {_description} as description,
  lpad(cast(user_id % 37 as string), 4, '0') as account,
  case user_id % 5 when 0 then 'chase' when 1 then 'gemini' when 2 then 'apple' when 3 then 'firsttech' else 'discover' end as institution,
  case when event_id % 2 = 0 then 'T' || cast(event_id % 4001 as string) end as transaction_id,
  case when event_id % 3 = 0 then 'cat' || cast(event_id % 4 as string) end as category,
  case when event_id % 5 = 0 then cast(user_id as decimal(18,2)) end as balance,
  'Account ' || cast(user_id % 37 as string) as account_name,
  case when user_id % 37 % 3 = 0 then 'credit' else 'debit' end as account_type
from (
  select event_id, user_id, ts, (event_id * 7 + user_id) % {len(TEMPLATES)} as t, regexp_extract(props, '[0-9]+', 0) as k,
    cast(floor(value / 5) * 50 as bigint) + event_id % 8 as tenths
  from {{events}}
) as e
"""

#: Several years of transactions, from orders, customers and nations.
ORDERS = """
select o_orderkey as txn_seq, 'data/' || n_name || '/' || cast(o_orderkey % 11 as string) || '.csv' as source_file, cast(o_orderdate as date) as date,
  case when o_orderkey % 4 = 0 then cast(o_totalprice as decimal(18,2)) else -cast(o_totalprice as decimal(18,2)) end as amount,
  case when o_orderkey % 16 = 0 then 'DEPOSIT PAYROLL ' || n_name when o_orderkey % 16 = 4 then 'Refund ' || o_orderpriority when o_orderkey % 16 = 1 then 'Withdrawal Transfer To ' || n_name
       when o_orderkey % 16 = 2 then 'OLB EXTERNAL TRANSFER' when o_orderkey % 16 = 3 then 'Payment Thank You' else o_orderpriority || ' PURCHASE' end as description,
  lpad(cast(c_custkey % 1000 as string), 4, '0') as account, n_name as institution, cast(null as string) as transaction_id, cast(null as string) as category,
  cast(null as decimal(18,2)) as balance, 'Customer ' || cast(c_custkey as string) as account_name, case when c_custkey % 2 = 0 then 'credit' else 'debit' end as account_type
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

#: Written dates, amounts and paths in the accepted formats, from orders.
STRINGS = """
select o_orderkey as txn_seq, o_orderkey % 8 as form, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as value,
  lpad(cast(month(o_orderdate) as string), 2, '0') as mm, lpad(cast(day(o_orderdate) as string), 2, '0') as dd, cast(year(o_orderdate) as string) as yyyy,
  cast(cast(floor(o_totalprice) as bigint) as string) as whole, lpad(cast(o_orderkey % 100 as string), 2, '0') as cents,
  case o_orderkey % 6 when 0 then 'raw/chase/statements-' || lpad(cast(o_custkey % 10000 as string), 4, '0') || '-.pdf' when 1 then 'raw/first_tech/acct_' || cast(100000 + o_custkey as string) || '.csv'
    when 2 then 'in/amex_' || cast(o_orderkey % 9 as string) || '.csv' when 3 then 'in/20240115_export.csv' when 4 then 'raw/usaa/x-' || cast(12340000 + o_custkey as string) || '.qfx' else 'in/bofa-statement.csv' end as path
from {orders}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS, events=read(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDERS, **{t: read(spark, sf_dir, t) for t in ("orders", "customer", "nation")})


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STRINGS, orders=read(spark, sf_dir, "orders"))


def sql(view: str) -> str:
    return view.format(events="events", orders="orders", customer="customer", nation="nation")
