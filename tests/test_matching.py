"""Matchings against the loop over rows in input order, in one slice and in many."""

import random
from functools import partial

import pytest
from tallyspark.operators import matching
from tallyspark.operators.matching import EqualParts, NearAmounts, ranked_days

EQUAL = {
    "days": (3, lambda d, e: abs(d - e)),
    "weekdays": (5, lambda d, e: 0 if (d + e) % 3 and abs(d - e) <= 5 else None),
}


def _score(a, b, most):
    days, diff, top = abs(a[1] - b[1]), abs(a[2] - b[2]), max(a[2], b[2])
    return None if days > most or (diff and diff * 10 >= top) else days + (0 if not diff else 10 if diff * 20 < top else 20)


def _loop(asking, partners, key):
    """Every asking row in order takes the free partner of the smallest key; key: None where the two can't be a pair."""
    free, out = set(partners), []
    for a in sorted(asking):
        can = [(k, b) for b in free if (k := key(asking[a], partners[b])) is not None]
        if can:
            free.discard(b := min(can)[1])
            out.append((a, b))
    return sorted(out)


def _kinds():
    for span, rank in EQUAL.values():
        key = lambda a, b, span=span, rank=rank: rank(a[1], b[1]) if a[0] == b[0] and a[3] != b[3] and abs(a[1] - b[1]) <= span else None
        yield span, lambda *rows, span=span, rank=rank: EqualParts(*rows, days=ranked_days(span, rank)), key
    yield 7, partial(NearAmounts, most=7), lambda a, b: _score(a, b, 7)


def _rows(rng, n, days, parts):
    seqs = rng.sample(range(10 * n), n)
    if rng.random() < 0.3:
        seqs.sort()
    when = sorted(rng.randrange(days) for _ in range(n))
    if rng.random() < 0.5:
        rng.shuffle(when)
    rows = {s: (rng.randrange(parts), d, rng.choice([100, 104, 96, 109, 91, 90, 1000, 951, 950]), rng.choice("AABC")) for s, d in zip(seqs, when)}
    return {s: r for s, r in rows.items() if s % 2}, {s: r for s, r in rows.items() if not s % 2}


def test_proposals_are_the_loop():
    rng = random.Random(1)
    for _ in range(150):
        for _, kind, key in _kinds():
            asking, partners = _rows(rng, rng.randrange(1, 60), rng.choice([1, 8, 40]), 2 if isinstance(kind, type(_kinds)) else 1)
            if kind.__class__ is partial:
                asking, partners = ({s: (0, *r[1:]) for s, r in side.items()} for side in (asking, partners))
            rows = kind(asking, partners, set(partners), {})
            assert rows.settle() == 0
            assert sorted((a, b) for b, a in rows.holder.items()) == _loop(asking, partners, key)


@pytest.mark.parametrize("most", [10**6, 30, 1])
def test_slices_change_nothing(spark, monkeypatch, most):
    """Large parts are cut in time: pairs are those of the loop, though chains of rows that let each other go cross slices."""
    monkeypatch.setattr(matching, "SLICE_ROWS", most)
    monkeypatch.setattr(matching, "SLICE_DAYS", 1)
    rng = random.Random(most)
    for span, kind, key in _kinds():
        parts = 1 if kind.__class__ is partial else 3
        asking, partners = _rows(rng, 400, 120, parts)
        rows = [(*r[:1], asks, s, *r[1:]) for asks, side in ((True, asking), (False, partners)) for s, r in side.items()]
        df = spark.createDataFrame(rows, "part long, asks boolean, seq long, day int, cents long, owner string").repartition(3)
        assert sorted(map(tuple, matching.matched(df, span, kind).collect())) == _loop(asking, partners, key)
    assert matching.matched(df.limit(0), span, kind).count() == 0


def test_a_chain_over_many_slices(spark, monkeypatch):
    """Later days come first in the input: each row lets the one before go, through all slices."""
    monkeypatch.setattr(matching, "SLICE_ROWS", 1)
    monkeypatch.setattr(matching, "SLICE_DAYS", 1)
    n = 90
    asking = {2 * (n - d) + 1: (1, d, 100, "A") for d in range(n)}
    partners = {2 * d: (1, d + 1, 100, "B") for d in range(n)}
    rows = [(1, asks, s, *r[1:]) for asks, side in ((True, asking), (False, partners)) for s, r in side.items()]
    df = spark.createDataFrame(rows, "part long, asks boolean, seq long, day int, cents long, owner string")
    span, kind, key = next(_kinds())
    assert sorted(map(tuple, matching.matched(df, span, kind).collect())) == _loop(asking, partners, key)


def test_a_million_rows_without_gaps_take_few_rounds(spark, monkeypatch):
    """One amount, rows on each of 20 years' days, more rows than a slice: as many jobs as for five years."""
    monkeypatch.setattr(matching, "SLICE_ROWS", 10_000)
    rounds = []
    for days in (1826, 7305):
        df = spark.range(days * 160).selectExpr("0L as part", "id % 2 = 0 as asks", "xxhash64(id) as seq", f"cast(id % {days} as int) as day", "100L as cents", "string(id % 7) as owner")
        found = []
        real = matching.materialise
        monkeypatch.setattr(matching, "materialise", lambda x: (found.append(1), real(x))[1])
        pairs = matching.matched(df, 3, lambda *rows: EqualParts(*rows, days=ranked_days(3, lambda d, e: abs(d - e))))
        monkeypatch.setattr(matching, "materialise", real)
        n, a, b = (pairs.selectExpr("count(*)", "count(distinct a)", "count(distinct b)").first())
        assert n == a == b > 0.95 * days * 80
        rounds.append(len(found))
    assert rounds[1] <= rounds[0] + 2 and max(rounds) < 14
