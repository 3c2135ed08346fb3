"""Operator 9: URL rules by host and path prefix, as a sort-merge range join.

A host is turned round (label by label) to a canonical key, so that a host and its subdomains form one interval of keys. Keys of
URLs and intervals of rules are dealt to ranges of keys; a rule goes to every range that its interval meets. In a range both
are sorted, and a sweep keeps a stack of the hosts with rules whose interval holds the current key: intervals nest, so the stack's top
leaves first. A host's paths stand in a table by length, so that a URL looks up one prefix of its path per length. Of the rules that
fit the longest wins (by the length of host and path together, then of the host; two can't tie in both).

There is a range for every RANGE_ROWS rows, RANGES at most; rows of a range stream through the sweep. Limits come from about SAMPLE
keys, chosen by a hash. A host that a third of the URLs have fills several ranges by its paths; a single key that would, is dealt to
all of them by a hash of the row.

Null URLs, and URLs without `://`, have an empty host and path; no rule fits them unless its host is empty too. An empty host has no
subdomains. Rules with a null host or path are ignored; of rules equal in host and path the one with the smallest verdict counts. Rows
without a fitting rule get the default. Repeated rows are judged each; very long URLs are read whole; an empty table gives an empty
result, an empty rule table the default. Columns other than page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
SAMPLE, RANGE_ROWS, RANGES = 20_000, 25_000, 4_000
END, NOWHERE = "\U0010ffff", "\x01"


def split_url(urls: DataFrame) -> DataFrame:
    """(page_id, host, path) of each row."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def turned(host: str = "host") -> F.Column:
    """a.example.org: org,example,a, (each label closed by a comma). An empty host stands apart from all others."""
    return F.when(F.col(host) == "", NOWHERE).otherwise(F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.")), ","), F.lit(",")))


def _dealt(limits: list[str]) -> Callable:
    """Task: (page_id, host, path, key) to the same and its range."""
    cuts = np.array(limits, dtype=object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            low, high = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
            spread = batch.column("spread").to_numpy() % (high - low + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "key")), pa.array(low + spread, pa.int64())], ["page_id", "host", "path", "key", "range"])

    return work


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ranges: rules before URLs of an equal key, wide rules before those inside them. Only the stack is held."""
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []
    at = None
    for t in batches:
        ranges, kind, keys, ends = (t.column(c).to_pylist() for c in ("range", "kind", "key", "until"))
        ids, hosts, paths, verdicts = (t.column(c).to_pylist() for c in ("page_id", "host", "path", "verdict"))
        out: dict[str, list] = {c: [] for c in ("page_id", "host", "path", "rule", "verdict")}
        for i, r in enumerate(ranges):
            if r != at:
                at, stack = r, []
            while stack and stack[-1][0] <= keys[i]:
                stack.pop()
            host, path = hosts[i], paths[i]
            if kind[i] == 0:
                if not stack or stack[-1][1] != host:
                    stack.append((ends[i], host, {}, []))
                stack[-1][2][path] = verdicts[i]
                if len(path) not in stack[-1][3]:
                    bisect.insort(stack[-1][3], len(path))
                continue
            best = (-1, -1, None, None)
            for _, h, known, lengths in stack:
                if host == h or h and host.endswith("." + h):
                    n = next((n for n in reversed(lengths) if path[:n] in known), None)
                    if n is not None:
                        best = max(best, (len(h) + n, len(h), h + path[:n], known[path[:n]]))
            for c, x in zip(out, (ids[i], host, path, best[2], best[3]), strict=True):
                out[c].append(x)
        kinds = {"page_id": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in out.items()], list(out))


def judged(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of urls (page_id, url). rules: (host, path, verdict); rule: host and path of
    the rule that decided, or null."""
    keyed = split_url(urls).withColumn("key", F.concat(turned(), "path")).withColumn("spread", F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30)))
    n = keyed.count()
    drawn = keyed.where(F.pmod(F.xxhash64("page_id", "key", F.lit(9)), F.lit(1_000_000)) < min(1.0, SAMPLE / max(n, 1)) * 1_000_000).select("key").limit(2 * SAMPLE)
    sample = sorted(r["key"] for r in drawn.collect())
    ranges = min(RANGES, max(1, -(-n // RANGE_ROWS)))
    limits = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    dealt = keyed.mapInArrow(_dealt(limits), "page_id long, host string, path string, key string, range long")
    spans = (
        rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", turned()).withColumn("until", F.concat("key", F.lit(END)))
    )
    # the ranges that an interval meets, from the sorted limits
    below = lambda c, other: F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: (x < F.col(c)) if other else (x <= F.col(c)))) if limits else F.lit(0)
    placed = spans.withColumn("range", F.explode(F.sequence(below("key", True).cast("long"), below("until", False).cast("long"))))
    both = dealt.select("range", "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("until"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        placed.select("range", "key", F.lit(0).alias("kind"), "until", F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )
    swept = spread(both, "range").sortWithinPartitions("range", "key", "kind", F.desc("until")).mapInArrow(_swept, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


ORACLE_SQL = """
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), f as (
  select h.*, r.*, row_number() over (partition by page_id order by length(rule_host) + length(rule_path) desc nulls last, length(rule_host) desc) as nth
  from h left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule_host || rule_path as rule, coalesce(rule_verdict, 'allow') as verdict from f where nth = 1
"""
