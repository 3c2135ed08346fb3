"""SQL for DuckDB that gives the same rows as the registered queries, written without looking at how Spark gets them."""

from __future__ import annotations

from ..functions import categories, text
from ..operators import signs, transfers
from .views import EVENTS, ORDERS, STRINGS, sql

_T, _O, _S = (f"with recursive t as ({sql(v)})" for v in (EVENTS, ORDERS, STRINGS))
#: Files and errors of a batch, from events; for Spark and DuckDB.
FILES = """
select 'in/' || cast(event_id as string) || '.csv' as file_path, md5(cast(event_id % 50 as string)) as file_hash, ts as last_processed, 'out/' || cast(event_id % 40 as string) as output_file,
  user_id % 100 as transaction_count, event_id % 10 <> 0 as success, cast(event_id % 97 + 1 as double) / 10 as processing_time, event_id * 13 % 9973 as file_size,
  case user_id % 5 when 0 then 'chase' when 1 then 'gemini' when 2 then 'apple' when 3 then 'firsttech' else 'discover' end as institution
from {events}
"""
ERRORS = """
select case event_id % 7 when 0 then 'F001' when 1 then 'D001' when 2 then 'V003' when 3 then 'F001' when 4 then 'S001' when 5 then 'C002' else 'D004' end as code,
  case when event_id % 7 in (0, 3) then 'file' when event_id % 7 in (1, 6) then 'data' else 'other' end as category, 'in/' || cast(event_id % 300 as string) as file_path
from {events} where event_id % 3 = 0
"""
#: OFX files of up to 20 orders each, and lines of statements; for Spark and DuckDB.
OFX = """
select 'raw/first_tech/export_' || cast(f as string) || '.qfx' as path,
  'OFXHEADER:100' || chr(10) || 'DATA:OFXSGML' || chr(10) || '<OFX><STMTRS><BANKACCTFROM><ACCTID>' || cast(500000000 + f as string) || chr(10) || '<BANKTRANLIST>' || max(r0) || max(r1) || max(r2) || max(r3) || '</BANKTRANLIST></STMTRS></OFX>' as content
from (select f, case when nth = 0 then r else '' end as r0, case when nth = 1 then r else '' end as r1, case when nth = 2 then r else '' end as r2, case when nth = 3 then r else '' end as r3 from (
  select cast(floor(o_orderkey / 4) as bigint) as f, o_orderkey % 4 as nth,
    '<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>' || cast(year(o_orderdate) as string) || lpad(cast(month(o_orderdate) as string), 2, '0') || lpad(cast(day(o_orderdate) as string), 2, '0') || '120000[-8:PST]' || chr(10)
    || '<TRNAMT>-' || cast(cast(o_totalprice as decimal(18,2)) as string) || chr(10) || '<FITID>T' || cast(o_orderkey as string) || chr(10) || '<NAME>PAYEE' || chr(10) || '<MEMO>' || o_orderpriority || ' STORE' || chr(10) || '</STMTTRN>' as r
  from {orders}) as one) as many
group by f
"""
PDF_LINES = """
select 'raw/chase/statements-8147-' || cast(f as string) || '.pdf' as path, 1 as page, cast(line_no as int) as line_no, line from (
  select distinct o_orderkey % 50 as f, 0 as line_no, 'Statement Period: 12/15/1995 - 01/14/1996' as line from {orders}
  union all
  select o_orderkey % 50 as f, o_orderkey + 1 as line_no,
    case o_orderkey % 4 when 0 then cast(month(o_orderdate) as string) || '/' || cast(day(o_orderdate) as string) || ' GROCERY ' || o_orderpriority || ' ' || cast(cast(o_orderkey % 900 as decimal(18,2)) as string)
      when 1 then '1996-' || lpad(cast(month(o_orderdate) as string), 2, '0') || '-' || lpad(cast(day(o_orderdate) as string), 2, '0') || ' Refund from store $' || cast(cast(o_orderkey % 900 as decimal(18,2)) as string)
      when 2 then 'Page ' || cast(o_orderkey as string) || ' of the statement' else 'Total on 01/15/1996 is unknown' end as line
  from {orders}) as x
"""
#: Rows of tables in statements, in two layouts and one that is no layout; for Spark and DuckDB.
PDF_TABLES = """
select 'raw/chase/statements-8147-' || cast(o_orderkey % 50 as string) || '.pdf' as path, cast(1 + o_orderkey % 5 as int) as page, cast(o_orderkey % 3 as int) as table_no, cast(o_orderkey % 900 as int) as row_no, o_orderkey as k,
  cast(o_orderdate as date) as day, cast(o_orderkey % 700 + 1 as decimal(18,2)) as value,
  split(case o_orderkey % 3 when 0 then 'Trans Date,Description,Amount,Balance' when 1 then 'Details,Credit,Posting Date' else 'Date,Note' end, ',') as header,
  split(case o_orderkey % 3 when 0 then written || ',STORE ' || cast(o_orderkey as string) || ',$' || cast(o_orderkey % 700 + 1 as string) || '.00,' || cast(o_orderkey as string)
    when 1 then 'PAYMENT ' || cast(o_orderkey as string) || ',' || cast(o_orderkey % 700 + 1 as string) || '.00,' || written else 'x,y' end, ',') as cells
from (select *, case when o_orderkey % 11 = 4 then '' when o_orderkey % 7 = 5 then 'soon' else lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || lpad(cast(day(o_orderdate) as string), 2, '0') || '/' || cast(year(o_orderdate) as string) end as written from {orders}) as o
"""
#: Rows of PDF statements, a header first on each page; for Spark and DuckDB. A third of the customers have tables, a third lines, a third both in turn.
_STATEMENT_ROWS = """
select *, case when o_custkey % 3 = 0 or o_custkey % 3 = 2 and page % 2 = 0 then true else false end as ruled from (
  select o_custkey, o_orderkey, cast(o_orderdate as date) as day, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as nth,
    cast(1 + floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 12) as int) as page,
    case o_orderkey % 4 when 0 then 'GROCERY ' || o_orderpriority when 1 then 'Refund from store' else 'STORE ' || cast(o_orderkey as string) || ' (A)' end as description,
    cast(o_orderkey % 700 + 1 as decimal(18,2)) as value
  from {orders}) as x"""
STATEMENTS = f"""with r as ({_STATEMENT_ROWS}), c as (
  select *, array(lpad(cast(month(day) as string), 2, '0') || '/' || lpad(cast(day(day) as string), 2, '0') || '/' || cast(year(day) as string), description, '$' || cast(value as string)) as cells from r)
select 'raw/chase/statements-8147-' || cast(o_custkey as string) || '.pdf' as path, page, ruled, o_custkey % 2 = 1 as packed, nth, 'Statement of page ' || cast(page as string) as title, cells from c
union all
select distinct 'raw/chase/statements-8147-' || cast(o_custkey as string) || '.pdf', page, ruled, o_custkey % 2 = 1, 0, 'Statement of page ' || cast(page as string), array('Trans Date', 'Description', 'Amount') from c
"""
#: CSV exports of a customer's orders in three layouts, one of which lacks amounts; for Spark and DuckDB.
_CSV_ROWS = """
select *, case when o_custkey % 3 = 2 then 'raw/first_tech/acct_9' else 'raw/chase/acct_5' end || lpad(cast(o_custkey as string), 6, '0') || '.csv' as path, cast(o_orderdate as date) as day,
  row_number() over (partition by o_custkey order by o_orderkey) as nth, cast(o_orderkey % 900 as decimal(18,2)) as value
from {orders}"""
CSV_FILES = f"""with r as ({_CSV_ROWS}) select path, max(header) || chr(10) || array_join(sort_array(collect_list(lpad(cast(nth as string), 9, '0') || line)), '') as content from (
  select path, nth, case o_custkey % 3 when 0 then 'n,Transaction Date,Amount ($),Memo,Reference Number' when 1 then 'n,date,Debit,Credit,payee,id,Balance' else 'n,date,note' end as header,
    ',' || case o_custkey % 3 when 0 then case when o_orderkey % 5 = 0 then 'soon' else cast(day as string) end || ',"(' || cast(value as string) || ')","POS DEBIT, ' || o_orderpriority || '",T' || cast(o_orderkey as string)
      when 1 then cast(day as string) || ',' || case when o_orderkey % 2 = 0 then cast(value as string) || ',' else ',' || cast(value as string) end || ',PAYEE ' || cast(o_orderkey as string) || ',' || cast(o_orderkey as string) || ',' || cast(value as string)
      else cast(day as string) || ',x' end || chr(10) as line from r) as x group by path"""
#: Files of many endings, some of them empty; for Spark and DuckDB.
MIXED_FILES = """
select distinct 'raw/' || case o_custkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end || case when o_custkey % 2 = 0 then '/deep' else '' end || '/f' || cast(o_custkey as string)
    || case o_custkey % 5 when 0 then '.csv' when 1 then '.QFX' when 2 then '.pdf' when 3 then '.txt' else '.ofx' end as path,
  case when o_custkey % 7 = 0 then '' when o_custkey % 5 = 2 then '%PDF-1.7 ' || cast(o_custkey as string) when o_custkey % 5 = 0 then 'Date,Amount' || chr(10) || '1,2' when o_custkey % 11 = 0 then 'nothing' else 'OFXHEADER:100' end as content
from {orders}"""
#: Lines that an ingest has rejected, from events; for Spark and DuckDB.
REJECTED = """
select 'in/' || cast(event_id % 200 as string) || '.csv' as source_file, cast(event_id as int) as line_no,
  case event_id % 5 when 0 then 'bad date' when 1 then 'bad amount' when 2 then 'missing columns: date' when 3 then 'date in the future' else 'description is empty' end as problem
from {events} where event_id % 4 = 0
"""
_KIND = "case when problem like 'missing columns%' then {0} when problem like 'bad %' then {1} when problem = 'no transactions' then {2} else {3} end"
#: Expressions over the view of written strings, for Spark and DuckDB.
WRITTEN_DATE = """case form when 0 then mm || '/' || dd || '/' || yyyy when 1 then yyyy || '-' || mm || '-' || dd when 2 then mm || '/' || dd || '/' || substr(yyyy, 3, 2) when 3 then yyyy || '/' || mm || '/' || dd
  when 4 then yyyy || mm || dd when 5 then yyyy || '-' || mm || '-' || dd || 'T10:00:00' when 6 then mm || '-' || dd || '-' || yyyy else 'unknown' end"""
_grouped = "case when length(whole) > 3 then substr(whole, 1, length(whole) - 3) || '{0}' || substr(whole, length(whole) - 2, 3) else whole end"
WRITTEN_AMOUNT = f"""case form when 0 then '$' || whole || '.' || cents when 1 then '(' || whole || '.' || cents || ')' when 2 then '-' || whole || '.' || cents when 3 then {_grouped.format(",")} || '.' || cents
  when 4 then {_grouped.format(".")} || ',' || cents when 5 then whole || ',' || cents when 6 then '+' || whole else 'n/a' end"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {_quote(w)})" for w in words) + ")"


def _fold(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {_quote(pattern)}, {_quote(to)}, 'g')"
    return x


def _space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_cleaned = _space(_fold(_space("description"), [(rf"(?i)^{p}\s+", "") for p in text.PREFIXES] + text.NOISE))
_normal = _space(_fold("trim(lower(description))", text.SIGNATURE_RULES))


def _merchant(prefixes: list[str], rules: list[tuple[str, str]], source: str = "t", name: str = "m") -> str:
    steps = [f"{name}0 as (select *, trim(lower(description)) as x from {source})"]
    for i, p in enumerate(prefixes):
        steps.append(f"{name}{i + 1} as (select * replace (case when starts_with(x, {_quote(p)}) then trim(substr(x, {len(p) + 1})) else x end as x) from {name}{i})")
    steps.append(f"{name} as (select * exclude (x), {_space(_fold('x', rules))} as merchant from {name}{len(prefixes)})")
    return ", ".join(steps)


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"case when {a} = '' or {b} = '' then 0.0 else len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))) end"


def _weekdays(a: str, b: str) -> str:
    return f"(select count(*) from range(least({a}, {b})::timestamp, greatest({a}, {b})::timestamp + interval 1 day, interval 1 day) r(d) where isodow(d) < 6)"


_short = [w for w in text.SPENDING if len(w) <= 3]
_type = f"""case when {_any("d", text.TRANSFER_OUT)} then 'transfer_out' when {_any("d", text.TRANSFER_IN)} then 'transfer_in' when {_any("d", text.CARD_PAYMENTS)} then 'transfer_out'
  when {_any("d", text.INCOME)} then 'income' when regexp_matches(d, '\\b({"|".join(_short)})\\b') or {_any("d", [w for w in text.SPENDING if len(w) > 3])} then 'spending' else 'unknown' end"""
_category = f"""case when {_any("lower(description)", categories.INTERNAL + categories.CARD_PAYMENT)} then 'internal_transfer' when {_any("lower(description)", categories.EXTERNAL)} then 'external_transfer'
  when account_type = 'credit' and {_any("lower(description)", categories.CARD_TRANSFER)} then 'internal_transfer' when amount < 0 then 'spending'
  when account_type <> 'credit' and {_any("lower(description)", categories.INCOME)} then 'income' else 'refund' end"""


def _rollup(entries: str) -> str:
    sums = ", ".join(f"cast(coalesce(sum(amount) filter (bucket = '{b}'), 0) as decimal(18,2)) as {b}" for b in ("income", "internal_transfer", "external_transfer", "credits", "spending"))
    return f"""select year, month, income, internal_transfer, external_transfer, credits, spending, cast(income + external_transfer + credits + spending as decimal(18,2)) as net, level
      from (select year, month, {sums}, cast(grouping(year, month) as int) as level from (select *, substr(month, 1, 4) as year from {entries}) group by rollup (year, month))"""


_entries = f"select txn_seq, strftime(date, '%Y-%m') as month, replace({_category}, 'refund', 'credits') as bucket, amount from t"
_clusters = f"""n as (select *, cast(abs(amount) as decimal(18,2)) as abs_amount, {_normal} as norm_description, account as account_key from t),
  g as (select *, case when date - lag(date) over w > 3 then 1 else 0 end as fresh from n window w as (partition by abs_amount, norm_description, account_key order by date, txn_seq)),
  c0 as (select *, cast(sum(fresh) over (partition by abs_amount, norm_description, account_key order by date, txn_seq) as bigint) as cluster_no from g),
  c as (select *, count(*) over (partition by abs_amount, norm_description, account_key, cluster_no) as cluster_size from c0)"""
_k = "abs_amount, norm_description, account_key, cluster_no"
_fuzzy = f"""{_clusters},
  p as (select *, row_number() over (partition by {_k} order by date, txn_seq) - 1 as pos from c),
  q as (select *, min(pos) over (partition by {_k}, date, amount, description, account, institution, transaction_id, category, balance) as place from p),
  s as (select *, (case when transaction_id <> '' then 1000 else 0 end) + (case when category <> '' then 100 else 0 end) + (case when balance is not null then 50 else 0 end) + (case when length(description) > 10 then 25 else 0 end) + place as score from q),
  f as (select *, row_number() over (partition by {_k} order by score desc, pos) as nth, first_value(transaction_id ignore nulls) over w as tid, first_value(category ignore nulls) over w as cat, first_value(balance ignore nulls) over w as bal
        from s window w as (partition by {_k} order by date, txn_seq rows between unbounded preceding and unbounded following)),
  z as (select txn_seq, date, amount, description, account, institution, account_name, account_type, coalesce(transaction_id, tid) as transaction_id, coalesce(category, cat) as category, coalesce(balance, bal) as balance, cluster_size from f where nth = 1)"""


def _lagged(source: str, where: str = "true", most: int = 3) -> str:
    return f"""select cast(abs(a.amount) as decimal(18,2)) as abs_amount, a.txn_seq as a_seq, b.txn_seq as b_seq, a.date as a_date, b.date as b_date, a.amount as a_amount,
      cast({_weekdays("a.date", "b.date")} as int) as lag
    from {source} a join {source} b on abs(a.amount) = abs(b.amount) and a.txn_seq < b.txn_seq and sign(a.amount) * sign(b.amount) < 0 and abs(a.date - b.date) <= 6 and ({where})
    where lag <= {most}"""


_apart = "a.institution <> b.institution or a.account <> b.account"
_pairs = f"""l as ({_lagged("t", _apart)}), x as (select abs_amount, case when a_amount < 0 then a_seq else b_seq end as source_seq, case when a_amount < 0 then b_seq else a_seq end as dest_seq,
   case when a_amount < 0 then a_date else b_date end as source_date, case when a_amount < 0 then b_date else a_date end as dest_date, lag from l)"""


def _greedy(name: str, edges: str, order: str) -> str:
    """The loop over edges in order, as a recursion that carries the used ends."""
    return f"""{name}_e as (select *, row_number() over (order by {order}) as rank from ({edges})),
      {name}_g(rank, used) as (select 0::bigint, []::bigint[] union all
        select n.rank, list_concat(g.used, [n.a, n.b]) from {name}_g g, lateral (select e.rank, e.a, e.b from {name}_e e where e.rank > g.rank and not list_contains(g.used, e.a) and not list_contains(g.used, e.b) order by e.rank limit 1) n),
      {name} as (select e.* from {name}_e e join {name}_g g on e.rank = g.rank)"""


def _sides(rules: list[tuple[str, str]]) -> str:
    return "(" + " or ".join(f"(contains(lower(institution), {_quote(i)}) and contains(lower(description), {_quote(d)}))" for i, d in rules) + ")"


_diff, _top = "abs(abs(r.amount) - abs(s.amount))", "greatest(abs(r.amount), abs(s.amount))"
_card = _greedy(
    "card",
    f"""select r.txn_seq as a, s.txn_seq as b, abs(r.date - s.date) as days, days + case when {_diff} = 0 then 0 when {_diff} * 20 < {_top} then 10 else 20 end as score
     from t r join t s on r.amount > 0 and s.amount < 0 and {_sides(transfers.CARD_RECEIVED).replace("institution", "r.institution").replace("description", "r.description")}
      and {_sides(transfers.CARD_SENT).replace("institution", "s.institution").replace("description", "s.description")} and abs(r.date - s.date) <= 7 and ({_diff} = 0 or {_diff} * 10 < {_top})""",
    "a, score, b",
)
_own = _greedy(
    "own",
    f"""select s.txn_seq as a, r.txn_seq as b, abs(s.date - r.date) as days from t s join t r on s.amount < 0 and r.amount > 0 and abs(s.amount) = abs(r.amount) and s.account <> r.account and abs(s.date - r.date) <= 3
      and {_any("lower(s.description)", transfers.TRANSFER_SENT)} and {_any("lower(r.description)", transfers.TRANSFER_RECEIVED)}""",
    "a, days, b",
)
_words = _any("lower(description)", transfers.TRANSFER_WORDS)
_timing = f"""{_card}, w as (select * from t where {_words} and txn_seq not in (select a from card union all select b from card)), wl as ({_lagged("w", _apart)}),
  {_greedy("timing", "select a_seq as a, b_seq as b, abs_amount, a_amount, lag from wl", "a, b")}, un as (select * from w where txn_seq not in (select a from timing union all select b from timing))"""
_spent = f"""{_merchant(text.MERCHANT_PREFIXES, text.MERCHANT_RULES)}, sp as (select *, abs(amount) as v from m where amount < 0),
  near as (select a.txn_seq as seq_a, b.txn_seq as seq_b, round({_jaccard("a.merchant", "b.merchant")}, 6) as similarity, {_jaccard("a.merchant", "b.merchant")} as sim, cast(abs(a.date - b.date) as int) as days_diff, cast(greatest(a.v, b.v) as decimal(18,2)) as exposure
    from sp a join sp b on round_even(a.v, 0) = round_even(b.v, 0) and a.txn_seq < b.txn_seq and a.source_file <> b.source_file and abs(a.date - b.date) <= 3 and abs(a.v - b.v) <= 1.00 where sim > 0.7)"""
_pq = f"""{_merchant(text.PAIR_PREFIXES, text.PAIR_RULES)}, sp as (select *, cast(abs(amount) as decimal(18,2)) as v from m where amount < 0),
  pq as (select a.txn_seq as remove_seq, b.txn_seq as keep_seq, round({_jaccard("a.merchant", "b.merchant")}, 6) as similarity, {_jaccard("a.merchant", "b.merchant")} as sim, cast(abs(a.date - b.date) as int) as days_diff, a.v as abs_amount
    from sp a join sp b on lower(a.institution) = lower(b.institution) and a.v = b.v and contains(a.source_file, '.pdf.') and contains(b.source_file, '.qfx.') and abs(a.date - b.date) <= 3 where sim >= 0.7)"""
_subset = "d as (select *, row_number() over (partition by date, amount, description, account, institution order by txn_seq) as nth from t)"
_accounts = "t2 as (select * replace (institution || account as source_file, cast(case when account::int % 3 = 0 then -amount else amount end as decimal(18,2)) as amount) from t)"


def _sign_stats(source: str) -> str:
    ratio = lambda k: f"coalesce(count(*) filter (kind = '{k}' and amount > 0) / nullif(count(*) filter (kind = '{k}'), 0), 0.0)"
    return f"""st as (select source_file, count(*) as total, count(*) filter (kind = 'spending') as spending_count, count(*) filter (kind = 'spending' and amount > 0) as spending_positive,
      count(*) filter (kind = 'income') as income_count, count(*) filter (kind = 'income' and amount > 0) as income_positive, {ratio("spending")} as spending_ratio, {ratio("income")} as income_ratio
      from (select *, {_type.replace("contains(d,", "contains(lower(description),").replace("regexp_matches(d,", "regexp_matches(lower(description),")} as kind from {source}) group by source_file)"""


_convention = f"""{_accounts}, {_sign_stats("t2")}, cv as (select *, spending_count + income_count as n,
  case when spending_count + income_count < 3 then 0 when spending_count >= 2 and income_count >= 1 and spending_ratio <= 0.2 and income_ratio >= 0.8 then 1 when spending_count >= 2 and income_count >= 1 and spending_ratio >= 0.8 and income_ratio <= 0.2 then 2
    when spending_ratio <= 0.3 and income_ratio >= 0.6 then 3 when spending_ratio >= 0.7 and income_ratio <= 0.4 then 4 when abs(spending_ratio - 0.5) < 0.3 or abs(income_ratio - 0.5) < 0.3 then 5 else 6 end as rule from st),
  cw as (select *, case when rule in (1, 3) then 'banking' when rule in (2, 4) then 'credit_card' when rule = 5 then 'mixed' else 'unknown' end as convention,
    case rule when 0 then 0.0 when 1 then least(0.9, 0.4 + n / 15) when 2 then least(0.9, 0.4 + n / 15) when 3 then least(0.7, 0.3 + n / 20) when 4 then least(0.7, 0.3 + n / 20) when 5 then 0.2 else 0.1 end as confidence from cv),
  cx as (select *, convention = 'credit_card' and confidence >= 0.5 as flip from cw)"""
_rough = """r as (select txn_seq, institution, transaction_id, balance, case when txn_seq % 17 = 0 then ' ' when txn_seq % 19 = 0 then 'x' else description end as description, case when txn_seq % 23 = 0 then '' else account end as account,
  case when txn_seq % 29 = 0 then '' else category end as category, cast(case when txn_seq % 31 = 0 then 0 when txn_seq % 37 = 0 then 2000000 else amount end as decimal(18,2)) as amount, case when txn_seq % 41 = 0 then date '1850-01-01' else date end as date from t),
  v as (select txn_seq, list_filter([case when amount = 0 then 'Warning: Transaction amount is zero' end, case when trim(description) = '' then 'Description cannot be empty' end,
    case when length(trim(description)) = 1 then 'Description too short (minimum 2 characters)' end, case when trim(account) = '' then 'Account cannot be empty' end, case when trim(category) = '' then 'Category cannot be empty string (use None instead)' end,
    case when year(date) < 1900 or year(date) > 2027 then 'Date year ' || year(date) || ' seems unreasonable' end, case when abs(amount) > 1000000 then 'Warning: Transaction amount is very large' end], lambda x: x is not null) as e from r)"""

SQL = {
    "monthly_category_rollup": f"{_O}, e as ({_entries}) {_rollup('e')}",
    "monthly_net_after_pairs": f"""{_T}, {_card}, {_own}, used as (select a as txn_seq from card union select b from card union select a from own union select b from own),
      e as (select * from ({_entries}) where txn_seq not in (select txn_seq from used) union all
            select b, strftime(date, '%Y-%m'), 'internal_transfer', amount from card join t on b = t.txn_seq union all
            select a, strftime(date, '%Y-%m'), 'internal_transfer', 0 from own join t on a = t.txn_seq) {_rollup("e")}""",
    "classify_category": f"{_T} select txn_seq, strftime(date, '%Y-%m') as month, {_category} as category from t",
    "category_of_statement_lines": f"{_O} select txn_seq, {_category} as category from t",
    "drilldown_net_cells": f"""{_T}, {_card}, {_own}, used as (select a as txn_seq from card union select b from card union select a from own union select b from own),
      e as (select txn_seq, month, bucket, amount, false as is_pair from ({_entries}) where txn_seq not in (select txn_seq from used) union all
        select txn_seq, strftime(t.date, '%Y-%m'), 'internal_transfer', t.amount, true from card join t on t.txn_seq = card.b union all select txn_seq, strftime(t.date, '%Y-%m'), 'internal_transfer', 0, true from own join t on t.txn_seq = own.a)
      select month, bucket, count(*) as n, cast(sum(e.amount) as decimal(18,2)) as total, count(*) filter (is_pair) as pairs, arg_min(txn_seq, [datediff('day', date '1970-01-01', t.date)::double, -abs(e.amount)::double, txn_seq::double]) as first_seq from e join t using (txn_seq) group by month, bucket""",
    "drilldown_cells": f"{_O}, e as ({_entries}) select month, bucket, count(*) as n, cast(sum(e.amount) as decimal(18,2)) as total, count(*) as listed, arg_min(txn_seq, [datediff('day', date '1970-01-01', t.date), -abs(t.amount), txn_seq]) as first_seq from e join t using (txn_seq) group by month, bucket",
    "parse_dates": f"{_S} select txn_seq, case when form <> 7 then cast(day as string) end as parsed from t",
    "parse_amounts": f"{_S} select txn_seq, cast(case when form in (0, 3, 4, 5) then cast(whole || '.' || cents as decimal(18,2)) when form in (1, 2) then -cast(whole || '.' || cents as decimal(18,2)) when form = 6 then cast(whole as decimal(18,2)) end as decimal(18,2)) as parsed from t",
    "clean_description": f"{_T} select txn_seq, case when {_cleaned} = '' then trim(description) else {_cleaned} end as cleaned from t",
    "normalize_signature_text": f"{_T} select txn_seq, {_normal} as normal from t",
    "merchant_analysis": f"{_T}, {_merchant(text.MERCHANT_PREFIXES, text.MERCHANT_RULES)} select txn_seq, merchant from m",
    "merchant_export": f"{_T}, {_merchant(text.PAIR_PREFIXES, text.PAIR_RULES)} select txn_seq, merchant from m",
    "institution_from_path": f"{_S} select txn_seq, case txn_seq % 6 when 0 then 'Chase' when 1 then 'First Tech' when 2 then 'American Express' when 3 then '20240115' when 4 then 'USAA' else 'Bank Of America' end as institution from t",
    "account_from_path": f"{_S} select txn_seq, case txn_seq % 6 when 0 then regexp_extract(path, 'statements-([0-9]+)-', 1) when 1 then right(regexp_extract(path, '([0-9]+)[.]csv', 1), 4) when 4 then right(regexp_extract(path, '([0-9]+)[.]qfx', 1), 4) else 'unknown' end as account from t",
    "business_days": f"{_O}, u as (select txn_seq, date, date + cast(txn_seq % 40 - 20 as int) as other from t) select txn_seq, cast({_weekdays('date', 'other')} as int) as days, isodow(date) < 6 as weekday from u",
    "token_jaccard": f"{_T}, {_merchant(text.MERCHANT_PREFIXES, text.MERCHANT_RULES)}, j as (select *, 'coffee house ' || lower(institution) as other from m) select txn_seq, round({_jaccard('merchant', 'other')}, 6) as similarity from j",
    "transaction_types": f"{_T} select txn_seq, {_type} as kind from (select *, lower(description) as d from t)",
    "signatures": f"{_T} select txn_seq, case when transaction_id <> '' then 'id:' || transaction_id else 'sig:' || substr(md5(cast(abs(amount) as varchar) || '|' || {_normal} || '|' || account), 1, 12) end as signature from t",
    "signature_groups": f"{_T}, n as (select cast(abs(amount) as decimal(18,2)) as abs_amount, {_normal} as norm_description, account as account_key from t) select *, count(*) as group_size from n group by all having group_size > 1",
    "cluster_sessions": f"{_T}, {_clusters} select txn_seq, cluster_no, cluster_size from c",
    "fuzzy_dedup_merge": f"{_T}, {_fuzzy} select txn_seq, cast(date as string) as date, amount, description, transaction_id, category, balance, cluster_size from z",
    "import_dedup_enriched": f"{_T}, {_fuzzy}, fi as (select institution, account, arg_min(account_name, txn_seq) as fn, arg_min(account_type, txn_seq) as ft from t group by all) select txn_seq, cast(date as string) as date, amount, case when cluster_size > 1 then fn else account_name end as account_name, case when cluster_size > 1 then ft else account_type end as account_type from z join fi using (institution, account)",
    "exact_dedup_keep_first": f"{_T}, k as (select txn_seq, row_number() over (partition by source_file, case when transaction_id <> '' then 'i' || transaction_id || date else 'r' || date || amount || lower(trim(description)) || '|' || account end order by txn_seq) as nth from t) select txn_seq from k where nth = 1",
    "subset_dedup": f"{_T}, {_subset} select txn_seq from d where nth = 1",
    "cross_file_duplicates": f"{_T}, {_clusters}, y as (select *, count(distinct source_file) over (partition by {_k}) as n_files from c) select txn_seq, cluster_size, n_files from y where n_files > 1",
    "mergeable_accounts": f"{_T} select account, lower(institution) as institution, count(distinct source_file) as n_files from t group by all having n_files > 1",
    "merge_account": f"{_T.replace('with recursive t as', 'with recursive t0 as')}, t as (select * from t0 where account = '0005' and institution = 'chase'), {_fuzzy} select txn_seq, cast(date as string) as date, amount, description from z",
    "dedup_stats": f"{_T}, {_clusters}, y as (select count(*) as n from c group by {_k}) select cast(coalesce(sum(n), 0) as bigint) as input_count, count(*) filter (n > 1) as duplicate_groups, cast(coalesce(sum(n - 1), 0) as bigint) as removed_count, count(*) as final_count from y",
    "import_stats": f"{_T}, {_clusters}, y as (select count(*) as n from c group by {_k}) select cast(coalesce(sum(n), 0) as bigint) as input_count, count(*) as final_count, cast(coalesce(sum(n - 1), 0) as bigint) as removed_count from y",
    "enrich_accounts": f"{_T} select txn_seq, case when account::int % 2 = 0 then 'Named ' || account else account end as account_name, case when account::int % 2 = 0 then 'credit' else 'debit' end as account_type from t",
    "transfer_pairs": f"{_T}, {_pairs} select abs_amount, source_seq, dest_seq, lag from x",
    "potential_transfers": f"{_T}, l as ({_lagged('t')}) select abs_amount, case when a_date <= b_date then a_seq else b_seq end as first_seq, case when a_date <= b_date then b_seq else a_seq end as second_seq, lag from l",
    "transfer_pairs_by_day": f"{_T}, {_pairs} select cast(least(source_date, dest_date) as string) as date, abs_amount, 2 * count(*) as rows from x group by all",
    "lag_distribution": f"{_T}, {_pairs} select lag, count(*) as pairs, round(count(*) / sum(count(*)) over (), 6) as share from x group by lag",
    "transfer_totals": f"{_T}, {_pairs} select abs_amount, count(*) as pairs, cast(sum(abs_amount) as decimal(18,2)) as total from x group by abs_amount",
    "card_payment_pairs": f"{_T}, {_card} select b as sent_seq, a as received_seq, cast(days as int) as days from card",
    "internal_transfer_pairs": f"{_T}, {_own} select a as sent_seq, b as received_seq, cast(days as int) as days from own",
    "timing_pairs": f"{_T}, {_timing} select case when a_amount < 0 then a else b end as source_seq, case when a_amount < 0 then b else a end as dest_seq, lag from timing",
    "unmatched_transfers": f"{_T}, {_timing} select txn_seq from un",
    "unmatched_by_month_top3": f"{_T}, {_timing}, um as (select strftime(date, '%Y-%m') as month, txn_seq, cast(abs(amount) as decimal(18,2)) as abs_amount from un), ur as (select *, row_number() over (partition by month order by abs_amount desc, txn_seq) as rank, count(*) over (partition by month) as count, cast(sum(abs_amount) over (partition by month) as decimal(18,2)) as total from um) select month, cast(rank as int) as rank, txn_seq, abs_amount, count, total from ur where rank <= 3",
    "match_rate": f"{_T}, {_timing}, c as (select (select count(*) from t where {_words}) as transfers, 2 * ((select count(*) from card) + (select count(*) from timing)) as matched) select transfers, matched, round(matched / nullif(transfers, 0), 6) as rate from c",
    "cross_month_impact": f"""{_O.replace("with recursive t as", "with recursive t0 as")}, t as (select * replace (cast(sign(amount) * (floor(abs(amount) / 500) * 500) as decimal(18,2)) as amount) from t0), {_pairs},
      im as (select strftime(source_date, '%Y-%m') as month, abs_amount as o, 0 as i, 1 as n from x where strftime(source_date, '%Y-%m') <> strftime(dest_date, '%Y-%m') union all select strftime(dest_date, '%Y-%m'), 0, abs_amount, 0 from x where strftime(source_date, '%Y-%m') <> strftime(dest_date, '%Y-%m'))
      select month, cast(sum(o) as decimal(18,2)) as outgoing_this_month, cast(sum(i) as decimal(18,2)) as incoming_next_month, cast(sum(i) - sum(o) as decimal(18,2)) as net_impact, cast(sum(n) as bigint) as count from im group by month""",
    "recent_pairs": f"{_T}, {_pairs} select source_seq, dest_seq, lag from x order by source_date desc, source_seq desc, dest_seq desc limit 5",
    "spending_near_duplicates": f"{_T}, {_spent} select seq_a, seq_b, similarity, days_diff, exposure from near",
    "duplicate_exposure": f"{_T}, {_spent} select count(*) as pairs, cast(coalesce(sum(exposure), 0) as decimal(18,2)) as exposure from near",
    "pdf_qfx_duplicates": f"{_T}, {_pq} select remove_seq, keep_seq, similarity, days_diff, abs_amount from pq",
    "pdf_qfx_removed": f"{_T}, {_pq} select txn_seq from t where txn_seq not in (select remove_seq from pq)",
    "pdf_qfx_removed_amount": f"{_T}, {_pq}, o as (select distinct remove_seq, abs_amount from pq) select count(*) as removed, cast(coalesce(sum(abs_amount), 0) as decimal(18,2)) as amount from o",
    "total_builder": f"""{_T}, {_subset}, b as (select *, trim(regexp_replace(trim(lower(description)), '#\\d+|\\s+\\w+\\s+wa\\s*$', '', 'g')) as raw from d where nth = 1), bb as (select * exclude (raw), {_space("raw")} as merchant from b),
      gone as (select a.txn_seq from bb a join bb c on a.amount < 0 and c.amount < 0 and a.institution = c.institution and a.amount = c.amount and strftime(a.date, '%Y-%m') = strftime(c.date, '%Y-%m') and contains(a.source_file, '.pdf.') and contains(c.source_file, '.qfx.')
        and abs(a.date - c.date) <= 3 and {_jaccard("a.merchant", "c.merchant")} >= 0.7) select txn_seq, source_file, amount from bb where txn_seq not in (select txn_seq from gone)""",
    "sign_stats": f"{_T}, {_sign_stats('t')} select * replace (round(spending_ratio, 6) as spending_ratio, round(income_ratio, 6) as income_ratio) from st",
    "sign_convention": f"{_T}, {_convention} select source_file, total, convention, round(confidence, 6) as confidence, flip from cx",
    "sign_corrected": f"{_T}, {_convention} select txn_seq, cast(case when flip then -amount else amount end as decimal(18,2)) as amount from t2 join cx using (source_file)",
    "pdf_sign_convention": f"{_T} select txn_seq, cast(case when {_any('lower(description)', signs.STATEMENT_CREDITS)} then abs(amount) when {_any('lower(description)', signs.STATEMENT_DEBITS)} then -abs(amount) else -amount end as decimal(18,2)) as amount from t",
    "validate_rows": f"{_T}, {_rough} select txn_seq, array_to_string(e, '; ') as errors from v",
    "valid_only": f"{_T}, {_rough} select txn_seq from v where len(e) = 0",
    "validation_summary": f"""{_T}, {_rough}, y as (select len(e) as n, len(list_filter(e, lambda x: starts_with(x, 'Warning:'))) as w from v) select count(*) as total, count(*) filter (n = w) as valid, count(*) filter (n > w) as with_errors, count(*) filter (w > 0) as with_warnings, cast(sum(n) as bigint) as messages from y""",
    "duplicate_row_flags": f"{_T} select txn_seq, row_number() over (partition by date, amount, description order by txn_seq) > 1 as duplicate from t",
    "dataset_summary": f"{_O} select count(*) as transactions, cast(min(date) as string) as first_date, cast(max(date) as string) as last_date, cast(sum(amount) filter (amount < 0) as decimal(18,2)) as spending, cast(sum(amount) filter (amount > 0) as decimal(18,2)) as income, cast(sum(amount) as decimal(18,2)) as net from t",
    "institution_counts": f"{_O} select institution, count(*) as transactions from t group by institution",
    "account_type_counts": f"{_O} select account_type, count(*) as transactions from t group by account_type",
    "payment_patterns_top5": f"""{_T}, y as (select txn_seq, case when contains(lower(description), 'thank you') then 'Payment Thank You' when contains(lower(description), 'cardpymt') then 'CardPymt (withdrawal)' when contains(lower(description), 'payment transaction') then 'Payment Transaction' else 'Other Payment' end as label
      from t where {_any("lower(description)", transfers.PAYMENT_WORDS)}), z as (select *, row_number() over (partition by label order by txn_seq) as rank, count(*) over (partition by label) as count from y) select label, cast(rank as int) as rank, txn_seq, count from z where rank <= 5""",
    "common_amounts": f"{_T} select amount as value from t where contains(source_file, '.pdf.') intersect select amount from t where contains(source_file, '.qfx.')",
    "common_descriptions": f"{_T} select description as value from t where contains(source_file, '.pdf.') intersect select description from t where contains(source_file, '.qfx.')",
    "id_frequency": f"{_T} select transaction_id, count(*) as times from t where transaction_id <> '' group by transaction_id having times > 1",
    "batch_summary": f"""with f as ({sql(FILES)}) select count(*) as total_files, count(*) filter (success) as successful, count(*) filter (not success) as failed, cast(sum(transaction_count) as bigint) as transactions, count(distinct output_file) as output_files,
      round(count(*) filter (success) / count(*), 6) as success_rate, round(sum(transaction_count) / sum(processing_time), 4) as per_second, (select file_path from f order by file_size desc, file_path desc limit 1) as largest_file, (select file_path from f order by processing_time desc, file_path desc limit 1) as slowest_file from f""",
    "institution_file_stats": f"with f as ({sql(FILES)}) select institution, count(*) as files, cast(sum(transaction_count) as bigint) as transactions, count(*) filter (not success) as failed, round(avg(processing_time), 6) as mean_time, count(distinct output_file) as output_files from f group by institution",
    "error_summary": f"with f as ({sql(ERRORS)}) select category, count(*) as errors, count(distinct file_path) as files from f group by category",
    "top5_errors": f"with f as ({sql(ERRORS)}) select code, count(*) as times from f group by code order by times desc, code limit 5",
    "transactions_match": f"""{_T}, n as (select txn_seq, coalesce(transaction_id, '') as id, date, amount, account, {_normal} as d from t)
      select a.txn_seq as seq_a, b.txn_seq as seq_b from n a join n b on a.id = b.id and a.txn_seq < b.txn_seq where a.id <> ''
      union all select a.txn_seq, b.txn_seq from n a join n b on a.account = b.account and a.txn_seq < b.txn_seq and abs(datediff('day', a.date, b.date)) <= 3
      where (a.id = '' or b.id = '') and abs(a.amount - b.amount) <= 0.01 and (a.d = b.d or a.d = '' or b.d = '')""",
    "incremental_skip": f"with f as ({sql(FILES)}) select file_path from f where file_size % 4 = 0 or file_size % 7 = 0 or not success",
    "latest_file_state": f"with f as ({sql(FILES)}) select output_file as file_path, 1::bigint as n, output_file as kept from f group by output_file",
    "ofx_roundtrip": """select 'T' || cast(o_orderkey as string) as transaction_id, cast(cast(o_orderdate as date) as string) as date, cast(-cast(o_totalprice as decimal(18,2)) as decimal(18,2)) as amount, o_orderpriority || ' STORE' as description,
      right(cast(500000000 + floor(o_orderkey / 4)::bigint as string), 4) as account, 'First Tech' as institution from orders""",
    "file_formats": "select unnest(['csv', 'pdf', 'qfx']) as format, (select count(distinct floor(o_orderkey / 4)::bigint) from orders) as n_files",
    "pdf_line_parse": f"""with l as ({sql(PDF_LINES)}), o as (select l.path, l.line_no, o_orderkey, o_orderdate, o_orderpriority from l join orders on l.line_no = o_orderkey + 1)
      select path as source_file, cast(100000 + line_no as int) as line_no, case when o_orderkey % 4 = 0 then case when month(o_orderdate) = 12 then '1995' else '1996' end else '1996' end || strftime(o_orderdate, '-%m-%d') as date,
        cast(case when o_orderkey % 4 = 0 then -(o_orderkey % 900) else o_orderkey % 900 end as decimal(18,2)) as amount, case when o_orderkey % 4 = 0 then 'GROCERY ' || o_orderpriority else 'Refund from store' end as description, '8147' as account, 'Chase' as institution
      from o where o_orderkey % 4 in (0, 1)""",
    "pdf_pattern_hits": f"""with l as ({sql(PDF_LINES)}) select path, line_no, cast(case when line_no = 0 then 2 when (line_no - 1) % 4 in (1, 3) then 1 else 0 end as bigint) as dates, cast(case when line_no > 0 and (line_no - 1) % 4 in (0, 1) then 1 else 0 end as bigint) as amounts
      from l where line_no = 0 or (line_no - 1) % 4 <> 2""",
    "pdf_table_rows": f"""with r as ({sql(PDF_TABLES)}) select path as source_file, cast(page * 100000 + table_no * 1000 + row_no as int) as line_no, case when k % 7 = 5 then null else strftime(day, '%Y-%m-%d') end as date,
      cast(case when k % 3 = 0 then -value else value end as decimal(18,2)) as amount, case when k % 3 = 0 then 'STORE ' || k else 'PAYMENT ' || k end as description,
      case when k % 3 = 0 then cast(k as decimal(18,2)) end as balance, '8147' as account, 'Chase' as institution, case when k % 7 = 5 then 'bad date' end as problem from r where k % 3 <> 2 and k % 11 <> 4""",
    "pdf_statements": f"""with r as ({sql(_STATEMENT_ROWS)}) select 'raw/chase/statements-8147-' || o_custkey || '.pdf' as source_file, cast(nth as bigint) as nth, strftime(day, '%Y-%m-%d') as date,
      cast(case when o_orderkey % 4 = 1 then value else -value end as decimal(18,2)) as amount, description, '8147' as account, 'Chase' as institution, cast(null as varchar) as problem from r""",
    "pdf_table_maps": f"""with r as ({sql(_STATEMENT_ROWS)}) select 'raw/chase/statements-8147-' || o_custkey || '.pdf' as path, page, strftime(day, '%m/%d/%Y') as date, description, '$' || value as amount from r where ruled""",
    "csv_source": f"""with r as ({sql(_CSV_ROWS)}), f as (select *, right(regexp_extract(path, 'acct_([0-9]+)', 1), 4) as account from r)
      select path as source_file, cast(nth as bigint) as line_no, case when o_custkey % 3 = 0 and o_orderkey % 5 = 0 then null else cast(day as varchar) end as date, cast(case when o_custkey % 3 = 0 or o_orderkey % 2 = 0 then -value else value end as decimal(18,2)) as amount,
        case when o_custkey % 3 = 0 then 'DEBIT, ' || trim(o_orderpriority) else 'PAYEE ' || o_orderkey end as description, case when o_custkey % 3 = 1 then value end as balance, case when o_custkey % 3 = 0 then 'T' || o_orderkey else cast(o_orderkey as varchar) end as transaction_id,
        account, 'Chase' as institution, case when o_custkey % 3 = 0 and o_orderkey % 5 = 0 then 'bad date' end as problem from f where o_custkey % 3 <> 2
      union all select distinct path, 0::bigint, null, null, null, null, null, null, null, 'missing columns: description, amount' from f where o_custkey % 3 = 2""",
    "ofx_source": """select 'raw/first_tech/export_' || floor(o_orderkey / 4)::bigint || '.qfx' as source_file, 'T' || o_orderkey as transaction_id, strftime(o_orderdate, '%Y-%m-%d') as date, cast(-o_totalprice as decimal(18,2)) as amount, o_orderpriority || ' STORE' as description,
      right(cast(500000000 + floor(o_orderkey / 4)::bigint as string), 4) as account, 'First Tech' as institution, null as problem from orders where starts_with(cast(floor(o_orderkey / 4)::bigint as varchar), '1')""",
    "pdf_source": f"""with r as ({sql(_STATEMENT_ROWS)}) select 'raw/chase/statements-8147-' || o_custkey || '.pdf' as source_file, count(*) as n, cast(sum(case when o_orderkey % 4 = 1 then value else -value end) as decimal(18,2)) as total, strftime(min(day), '%Y-%m-%d') as first_date, 0::bigint as problems from r group by 1""",
    "scan_supported": f"""with f as ({sql(MIXED_FILES)}) select path, length(content) as length, case when starts_with(content, '%PDF') then 'pdf' when starts_with(content, 'OFX') then 'qfx' when starts_with(content, 'Date') then 'csv' end as format from f where content <> '' and path not like '%.txt' and path not like 'raw/c/%'""",
    "scan_by_ending": f"""with f as ({sql(MIXED_FILES)}) select path, length(content) as length from f where path like 'raw/a/deep/%.QFX' and content <> ''""",
    "lenient_reader": f"{_T} select account, institution, count(*) as n, cast(sum(amount) as decimal(18,2)) as total, count(balance) as balances from t where txn_seq % 7 <> 0 group by account, institution",
    "state_log": f"with f as ({sql(FILES)}) select institution, success and file_size % 5 <> 0 as success, count(*) as files, cast(sum(case when file_size % 5 = 0 then 0 else transaction_count end) as bigint) as transactions from f group by 1, 2",
    "state_history": f"with f as ({sql(FILES)}) select file_path, institution, transaction_count from f where last_processed >= (select max(last_processed) from f) - interval 10 day and contains(file_path, 'in/9')",
    "best_parser": f"{_S} select txn_seq, case txn_seq % 6 when 0 then 'pdf' when 2 then 'amex' when 4 then 'raw' else 'csv' end as parser from t",
    "written_file_errors": f"""{_T}, r as (select txn_seq as line, list_filter([case when txn_seq % 11 = 0 then 'Invalid date format' end, case when txn_seq % 13 = 0 then 'Invalid amount format' end, case when txn_seq % 13 <> 0 and txn_seq % 17 = 0 then 'Amount has more than 2 decimal places' end,
      case when txn_seq % 19 = 0 then 'Account is empty' end, case when txn_seq % 23 = 0 or length(transaction_id) between 1 and 2 then 'Transaction ID too short' end, case when txn_seq % 29 = 0 then 'Invalid account type' end], lambda x: x is not null) as e from t) select line, array_to_string(e, '; ') as errors from r where len(e) > 0""",
    "consolidated_export": f"{_T} select strftime(date, '%Y-%m') as month, count(*) as n, cast(sum(amount) as decimal(18,2)) as total, 0::bigint as back, (select count(*) from t) as rows from t group by 1",
    "near_duplicates_by_similarity": f"{_T}, {_spent} select row_number() over (order by similarity desc, exposure desc, seq_a, seq_b) as place, seq_a, seq_b, round(similarity, 6) as similarity from near",
    "error_rows": f"""with r as ({sql(REJECTED)}), f as ({sql(FILES)}), p as (select source_file, line_no, problem from r union all select file_path, null, 'no transactions' from f where not success)
      select {_KIND.format("'F002'", "'D001'", "'F003'", "'V001'")} as code, {_KIND.format("'error'", "'warning'", "'error'", "'warning'")} as severity, {_KIND.format("'file_format'", "'data_parsing'", "'file_format'", "'data_validation'")} as category,
        problem as message, source_file as file_path, cast(line_no as bigint) as line from p""",
    "error_report": f"""with r as ({sql(REJECTED)}), f as ({sql(FILES)}), p as (select source_file, problem, {_KIND.format("'F002'", "'D001'", "'F003'", "'V001'")} as code from (select source_file, problem from r union all select file_path, 'no transactions' from f where not success))
      select count(*) filter (code like 'F%') as errors, count(*) filter (code not like 'F%') as warnings, count(distinct source_file) filter (code like 'F%') as files_with_errors, count(*) filter (code like 'F%') as file_format,
        count(*) filter (code = 'D001') as data_parsing, count(*) filter (code = 'V001') as data_validation, case when count(*) filter (code = 'F002') >= count(*) filter (code = 'F003') then 'F002' else 'F003' end as first_code from p""",
    "duplicate_prevention": f"""with f as ({sql(FILES)}), o as (select distinct output_file from f where file_size % 3 = 0) select file_path, success as previous_success, transaction_count as previous_transaction_count, output_file as previous_output_file,
      file_size % 7 = 0 as file_changed, output_file in (select output_file from o) as output_file_exists, file_size % 7 = 0 or output_file not in (select output_file from o) or not success as should_reprocess from f where file_size % 4 <> 0""",
    "canonical_roundtrip": f"{_T} select cast(date as varchar) as date, amount, description, account, account_name, account_type, institution, transaction_id, category, balance from t",
    "csv_layouts": f"""{_S} select 'T' || txn_seq as transaction_id, case when form > 5 then null else cast(day as varchar) end as date,
      cast(case when form = 3 or form > 5 then -value else value end as decimal(18,2)) as amount, case when form < 3 then 'DEBIT, ' || path when form < 6 then 'PAYEE' else 'Card Charge' end as description,
      case when form between 3 and 5 then value end as balance, 'First Tech' as institution, case when form > 5 then 'bad date' end as problem from t""",
}
SQL["summary_beside_the_write"] = SQL["dataset_summary"]
SQL["total_files"] = f"select institution, count(*) as n, cast(sum(amount) as decimal(18,2)) as total, count(balance) as balances from (select txn_seq from ({SQL['total_builder']})) join ({sql(EVENTS)}) using (txn_seq) group by institution"
