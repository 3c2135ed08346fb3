"""Operators 11 to 13 against brute force and libraries, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from tallyspark.llm import anchors, byte_bpe, periodic_runs


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer(byte_bpe.tokenizer_path()), tokenizers.Tokenizer.from_file(byte_bpe.tokenizer_path())


def _ids(tokenizer, text):
    return np.frombuffer(b"".join(tokenizer.stream(text)), dtype="<u4").tolist()


def test_ids_are_the_librarys(spark, tokenizer):
    mine, library = tokenizer
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    alphabets = ["ab", "-", "=-", "01", "é中", "aAbB .", "\n\t  x", " ", "\x1c\x85 ​'tI'll", "<|endoftext|>"]
    texts += ["".join(rng.choice(a) for _ in range(rng.choice([3, 60, 9_000]))) for a in alphabets for _ in range(4)]
    texts += ["a" * 100_000 + "<|endoftext|><|endoftext|> b", "x " * 80_000, ("word" + " " * 50) * 3000]
    assert [_ids(mine, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_of_characters_are_the_librarys(tokenizer):
    mine, library = tokenizer
    texts = ["a" + "".join(f"{chr(c)}1 {chr(c)}" for c in range(k, k + 16)) for k in [*range(0, 0xD800, 16), *range(0xE000, 0x32000, 16)]]
    assert [_ids(mine, t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_text_is_the_librarys_for_any_ids(tokenizer):
    mine, library = tokenizer
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(50_257) if rng.random() < 0.7 else rng.randrange(256) for _ in range(rng.randrange(40))]
        assert "".join(mine.text_of(np.array(ids, dtype="<u4"))) == library.decode(ids, skip_special_tokens=False)


def test_small_windows_change_nothing():
    """Random lists of merges: with the smallest window that the lookahead allows, tokens are those of the whole word and the library's."""
    rng = random.Random(5)
    looks = set()
    for _ in range(60):
        pieces, pairs = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])], []
        for _ in range(rng.randrange(1, 25)):
            x, y = rng.choice(pieces), rng.choice(pieces)
            if x + y not in pieces and len(x + y) <= 12:
                pieces.append(x + y)
                pairs.append((x, y))
        ids = {p: i for i, p in enumerate(pieces)} | {bytes([b]): 1000 + b for b in range(256) if bytes([b]) not in pieces}
        merges = byte_bpe.Merges(ids, pairs)
        looks.add(merges.lookahead)
        merges.window = merges.lookahead + max((len(x + y) for x, y in pairs), default=1)
        library = tokenizers.models.BPE({p.decode(): i for p, i in ids.items() if i < 1000}, [(x.decode(), y.decode()) for x, y in pairs])
        library = tokenizers.Tokenizer(library)
        for _ in range(20):
            word = bytes(rng.choice(b"abc"[: len([p for p in pieces if len(p) == 1])]) for _ in range(rng.randrange(1, 300)))
            whole = merges.merged(word)
            assert [t for part in merges.stream(word) for t in part] == whole == merges._by_heap([merges.of_byte[b] for b in word])
            assert whole == library.encode(word.decode()).ids
    assert max(looks) > 12 and byte_bpe.sufficient_lookahead([]) == 0
    with pytest.raises(ValueError, match="no earlier merge"):
        byte_bpe.Merges({bytes([b]): b for b in range(256)}, [(b"ab", b"c")])


def test_odd_texts_encode(spark, docs, corpus, tokenizer):
    rows = byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(docs))).collect()
    want = []
    for i, t, *_ in corpus:
        ids = tokenizer[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(docs.limit(0)))).count() == 0
    nothing = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(nothing))).collect()) == [(None, 0), (None, 2)]


def _plain_codes(rows):
    """(codes and errors in the order of rows, codebooks) of rows (vec_id, vector, ...), all kept, by Python's integers."""
    v = [[(int(x) * 4096 if abs(x) > 2**52 else int(np.floor(x * 4096))) for x in r[1]] for r in rows]
    w = len(v[0]) // 8
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    cut = [[x[p * w : (p + 1) * w] for p in range(8)] for x in v]
    books = [[cut[i][p] for i in order[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        new = []
        for p in range(8):
            of = [nearest(x[p], p)[1] for x in cut]
            mine = [[x[p] for x, o in zip(cut, of, strict=True) if o == k] for k in range(len(books[p]))]
            new.append([[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)])
        books = new
    found = [[nearest(x[p], p) for p in range(8)] for x in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def _check_codes(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' as code", "1 as error", "2 as n", "3 as part")
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1])]
    codes, books = _plain_codes(kept)
    total = {}
    for r, (_, e) in zip(kept, codes, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    want = [(r[0], c, fits(e), fits(total[r[2]]), digest) for r, (c, e) in zip(kept, codes, strict=True)]
    got = anchors.with_label_errors(*anchors.compressed(df.repartition(3))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_codes_are_plain_k_means(spark):
    rng = np.random.default_rng(6)
    spots = rng.normal(size=(30, 16))
    rows = [(int(i), [float(np.float32(x)) for x in spots[rng.integers(30)] + rng.normal(size=16) * 0.02], int(rng.integers(3)) or None) for i in range(700)]
    rows += [(int(i), [float(x) / 4096 for x in rng.integers(-1, 2, 16)], 4) for i in range(300)]  # repeated ids, ties
    rows += [(5000, None, 1), (5001, [], 1), (5002, [1.0] * 15 + [None], 1), (5003, [float("nan")] * 16, 1), (5004, [float("inf")] * 16, 1), (5005, [1.0] * 8, 1), (5006, [0.0] * 16, 1), (None, [0.5] * 16, 1)]
    rows += [(6000, [0.25] * 16, 7)] * 400
    _check_codes(spark, rows)
    _check_codes(spark, rows, "float")


def test_codes_of_few_and_of_huge_numbers(spark):
    rng = random.Random(7)
    _check_codes(spark, [(i, [rng.gauss(0, 1) for _ in range(16)], 1) for i in range(5)])
    _check_codes(spark, [(i, [rng.choice([1.0, 3e4, -2e9, 1e300, 1e307]) * rng.random() for _ in range(16)], i % 2) for i in range(40)])
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for df in (none, none.limit(0)):
        assert anchors.with_label_errors(*anchors.compressed(df)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        anchors.compressed(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def test_balls_strike_candidates_and_own_entries():
    """Trees hold each point once, balls hold their points, and on clustered data most points are assigned with their ball."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32)) * 0.01
    v = anchors.integers(x).reshape(3000, 8, 4)
    t = anchors.Trees.load(anchors.grown(v).dump())
    for p in range(8):
        assert sorted(t.order[p].tolist()) == list(range(3000))
        for b in np.flatnonzero(t.part == p):
            points = v[t.order[p, t.start[b] : t.end[b]], p]
            assert (t.sums[b] == points.sum(axis=0)).all() and np.sqrt(((points - t.centre[b]) ** 2).sum(axis=1)).max() <= t.radius[b] + 1e-6
    books = [v[:16, p].copy() for p in range(8)]
    code, sums, counts = anchors.assigned(v, t, books)
    for p in range(8):
        d = ((v[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        assert (code[p] == d.argmin(axis=1)).all() and counts[p].sum() == 3000
        assert all((sums[p][e] == v[code[p] == e, p].sum(axis=0)).all() for e in range(16))
    compared = []
    np_nonzero, anchors.np.nonzero = np.nonzero, lambda m: (compared.append(m.size and int(m.sum())), np_nonzero(m))[1]
    try:
        anchors.assigned(v, t, books)
    finally:
        anchors.np.nonzero = np_nonzero
    assert sum(compared) < 0.1 * 8 * 3000 * 16


def _plain_runs(x, least=12):
    """(start, length, period) of runs by all periods."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items() if n >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_all_periods():
    rng = random.Random(9)
    for _ in range(1500):
        n = rng.randrange(rng.choice([30, 80, 250]))
        x = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n - 10), rng.randrange(1, 14)
            for i in range(a + p, n):
                x[i] = x[i - p]
            x[rng.randrange(n)] = rng.choice([0, 99])
        assert periodic_runs.runs(np.array(x, dtype=np.int64)) == _plain_runs(x), x
    fibonacci = ["0", "01"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    x = [int(c) for c in fibonacci[-1]]
    assert periodic_runs.runs(np.array(x)) == _plain_runs(x)


def test_few_segments_are_crossed():
    """A path's segments stay few: about the logarithm of the length in the mean, also on words whose links are deep."""
    rng = random.Random(10)
    for x in ([0] * 3000, [i % 7 for i in range(3000)], [rng.randrange(2) for _ in range(3000)]):
        automaton = periodic_runs.Automaton()
        assert sum(len(automaton.append(w, i)) for i, w in enumerate(x)) < 8 * 3000


def test_last_occurrences():
    """Colours are the ends of last occurrences, and lengths those of the strings that have them."""
    rng = random.Random(11)
    x = [rng.randrange(3) for _ in range(120)]
    automaton = periodic_runs.Automaton()
    for i, w in enumerate(x):
        found, low = {}, 0
        for hi, end in reversed(automaton.append(w, i)):
            found |= dict.fromkeys(range(low + 1, hi + 1), end)
            low = hi
        for m in range(1, i + 2):
            before = [e for e in range(m - 1, i) if x[e - m + 1 : e + 1] == x[i - m + 1 : i + 1]]
            assert found.get(m, -1) == (max(before) if before else -1)


def _plain_text(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_texts_collapse(spark, docs, corpus):
    extra = [(500, "a b " * 400), (501, "x y " * 30), (502, "é\x0bé\x0cé " * 9), (503, " ".join(["q w e r t y"] * 2) + " q"), (504, "one two three four five six " * 2), (None, "z " * 20), (505, "same " * 11)]
    given = [(i, t) for i, t, *_ in corpus] + extra
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "'x' as words", "1 as h", "2 as n", "3 as runs", "4 as best").repartition(3)
    want, digest = [], []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for plant in (False, True):
        for i, t in given:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            h, n = zlib.crc32(str(i).encode()), len(words)
            if plant and i is not None and h % 10 == 0 and n:
                a = h // 10 % n
                p = 1 + (n - a) // (3 + h // 10 % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            runs = _plain_runs(words) if n < 5000 else []
            text = _plain_text(words, runs)
            if not plant:
                want.append((i, runs, text))
            else:
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                digest.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text)))
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic_runs.searched(df).collect()]
    assert sorted(found, key=str) == sorted(want, key=str) and sum(bool(r) for _, r, _ in want) >= 5
    planted = [tuple(r) for r in periodic_runs.digests(periodic_runs.searched(periodic_runs.planted(df))).collect()]
    assert sorted(planted, key=str) == sorted(digest, key=str) and sum(d[1] > 0 for d in digest) > 8
    assert periodic_runs.digests(periodic_runs.searched(periodic_runs.planted(df.limit(0)))).count() == 0


def test_a_giant_periodic_text():
    x = np.tile(np.arange(1000), 60)
    assert periodic_runs.runs(x) == [(0, 60_000, 1000)]
