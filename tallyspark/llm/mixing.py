"""Operator 5: document rates that mix a corpus to target domain weights, by soft membership. DataFrame functions only.

A labelled table (doc_id, quality, toxic) names three domains. A naive Bayes classifier over hashed words learns them from at most
SAMPLE_DOCS labelled texts (chosen by a hash of doc_id; the bound of the broadcast sample) and gives every document a posterior:
the prior's log odds plus the mean log odds of its words, weighted as EVIDENCE words at most, so that long texts stay soft.

The rates r >= 0 minimise f = sum over domains k of (E_k - T_k)^2 / D_k, where E_k = sum of r * tokens * posterior_k is the
expected token total, T_k the target and D_k the total at r = 1; of the rates that do, those nearest to 1: RIDGE times the sum of tokens * (r - 1)^2 is
added to f. Projected gradient with lazy projection: from l = 0 gradient steps are summed up in l, and r = max(0, 1 - sum_k posterior_k * l_k) is always
the projection of the whole sum, not of the last step. The gradient in l is E - T - RIDGE * D * l. It is scaled by its curvature, H + RIDGE * D
with H_jk = sum of tokens * posterior_j * posterior_k over the documents whose rate is above 0, so a step without documents at 0 meets the targets at once;
where a step doesn't lessen the function whose gradient this is (it is convex in l, and has its minimum where f with the ridge has), a quarter of it is tried. The fit
ends when all totals are CLOSE to their targets, or when the gradient is 0 but for FLAT of all tokens: then no rates come nearer, and the targets lie beyond what rates can
reach, as those of a domain that no document is sure not to belong to. The returned gap, the largest |E_k - T_k| as a part
of all tokens, says by how much they are missed, and `mixed` warns of it.

A document's rate follows from its posterior and l, so a step is one pre-aggregated pass over a table of a few
numbers per document, which returns one row. About a dozen steps reach the minimum; STEPS bounds them.

Null and empty texts have no tokens, the prior as posterior, and take the rate that follows from it. Without labelled rows all
priors are equal. Labels that are null in both columns are ignored; a doc_id labelled twice counts twice. Repeated rows count
as often as they stand. Very long texts count whole. An empty table gives an empty result, with a gap of 0. Other columns are ignored,
whatever their names. There are no ties: rates are functions of the posterior.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitting, fresh, materialise

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.93, "low": 0.06, "toxic": 0.01}
SAMPLE_DOCS, BUCKETS, EVIDENCE = 8_000, 4_096, 40
CLOSE, FLAT, RIDGE, STEPS = 1e-4, 1e-6, 1e-8, 100
P = [f"p_{d}" for d in DOMAINS]


def domain() -> Column:
    """Of a label row."""
    return F.expr("case when toxic = 1 then 'toxic' when quality = 1 then 'high' when quality is not null or toxic is not null then 'low' end")


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "\n\t\r", "   "), " "), "")


def _buckets(text: str = "text") -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _numbers(values: list[float]) -> Column:
    return F.expr("array(" + ",".join(f"{x:.8e}D" for x in values) + ")")


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[float], list[list[float]]]:
    """Log priors of DOMAINS, and for each domain but the first its words' log odds against the first, by bucket."""
    named = labels.select("doc_id", domain().alias("domain")).where("domain is not null and doc_id is not null")
    counts = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = [math.log((counts.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    share = min(1.0, sample_docs / max(total, 1))
    sample = named.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).limit(2 * sample_docs)
    each = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(_buckets()).alias("bucket"))
    seen = each.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]).collect()
    n = [[1.0] * BUCKETS for _ in DOMAINS]
    for r in seen:
        for k, d in enumerate(DOMAINS):
            n[k][r["bucket"]] += r[d]
    log = [[math.log(x / sum(row)) for x in row] for row in n]
    return prior, [[a - b for a, b in zip(row, log[0], strict=True)] for row in log[1:]]


def posteriors(docs: DataFrame, prior: list[float], odds: list[list[float]]) -> DataFrame:
    """(doc_id, tokens, posteriors P) of every row."""
    size = F.coalesce(F.size("buckets"), F.lit(0))
    weight = F.least(size, F.lit(EVIDENCE)) / F.greatest(size, F.lit(1))
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), _buckets()).alias("buckets"))

    def total_odds(row: list[float]) -> Column:
        weights = _numbers(row)
        return F.coalesce(F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get(weights, b)), F.lit(0.0))

    sums = [F.lit(prior[k + 1] - prior[0]) + weight * total_odds(row) for k, row in enumerate(odds)]
    scored = rows.select("doc_id", F.greatest(size, F.lit(0)).cast("long").alias("tokens"), F.array(F.lit(0.0), *sums).alias("z"))
    powers = scored.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    return powers.select("doc_id", "tokens", *[(F.col("e")[k] / total).alias(p) for k, p in enumerate(P)])


def rate(steps: list[float]) -> Column:
    """A document's rate by the summed steps, from its posteriors."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(p) * float(x) for p, x in zip(P[1:], steps[1:], strict=True)), F.col(P[0]) * float(steps[0])))


def fit(scored: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> tuple[list[float], float]:
    """The summed gradient steps that lead to the targets (weights of DOMAINS, of a budget of tokens; all there are, by default), and the gap."""
    targets, n = targets or TARGETS, len(DOMAINS)
    pairs = [(j, k) for j in range(n) for k in range(j, n)]

    def totals(l: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:  # noqa: E741
        """Expected totals, curvature, and half the sum of tokens * rate^2."""
        rows = scored.select("tokens", *P, rate(l.tolist()).alias("rate"))
        curvature = [F.sum(F.when(F.col("rate") > 0, F.col("tokens") * F.col(P[j]) * F.col(P[k]))) for j, k in pairs]
        row = [float(x or 0.0) for x in rows.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(p)) for p in P], *curvature, F.sum(F.col("tokens") * F.col("rate") * F.col("rate"))).first()]
        h = np.zeros((n, n))
        for (j, k), x in zip(pairs, row[n:-1], strict=True):
            h[j, k] = h[k, j] = x
        return np.array(row[:n]), h, row[-1] / 2

    steps = np.zeros(n)
    now, h, half = totals(steps)
    base = np.maximum(now, 1e-9)
    tokens = float(now.sum())
    size = tokens if budget is None else budget
    goal = size * np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    gap = lambda e: float(np.abs(e - goal).max()) / size if size else 0.0
    value = lambda l, half: half + float(goal @ l + RIDGE / 2 * (base * l * l).sum())  # noqa: E731, E741
    for _ in range(STEPS if tokens else 0):
        gradient = now - goal - RIDGE * base * steps
        if gap(now) <= CLOSE or np.abs(gradient).max() <= FLAT * tokens:
            break
        step = np.linalg.solve(h + np.diag(RIDGE * base + 1e-12 * tokens), gradient)
        part = 1.0
        while True:
            there = totals(steps + part * step)
            if value(steps + part * step, there[2]) <= value(steps, half) - 1e-4 * part * float(gradient @ step) or part < 1e-6:
                break
            part /= 4
        steps, (now, h, half) = steps + part * step, there
    return steps.tolist(), gap(now)


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic, rate, gap) of every row; gap is one number, that of the whole fit."""
    scored = materialise(posteriors(docs, *learn(docs, labels)))
    steps, gap = fit(scored, targets)
    return scored.select("doc_id", "tokens", *P, rate(steps).alias("rate"), F.lit(gap).alias("gap"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with every document as often as its rate says: the whole part always, one more by a hash of doc_id that is uniform in
    [0, 1) and falls below the rest. Rows without doc_id stand once; rows that share one stand equally often.

    How often is computed on the table of posteriors and joined back, only for documents that don't stand once: a filter on the
    rate of docs itself would be pushed below the projections and repeat all they compute."""
    scored = materialise(posteriors(docs, *learn(docs, labels)))
    steps, gap = fit(scored, targets)
    if gap > CLOSE:
        warnings.warn(f"no rates meet the target weights: one is missed by {gap:.4f} of all tokens", stacklevel=2)
    rates = materialise(scored.where("doc_id is not null").select("doc_id", rate(steps).alias("rate")))
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(55)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + F.when(uniform < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    n, nth = fresh(docs, "times"), fresh(docs, "nth")
    other = rates.groupBy("doc_id").agg(F.max(times).cast("int").alias(n)).where(F.col(n) != 1)
    both = docs.join(fitting(other), "doc_id", "left").withColumn(n, F.coalesce(n, F.lit(1))).where(F.col(n) > 0)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
