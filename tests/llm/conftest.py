import random

import pytest

EXTRA = ["item", "key", "sig", "first", "kept", "class_id", "n", "p", "rate", "tokens", "v", "cell", "block", "host", "path", "range", "domain", "bucket", "held_out", "spans", "nth"]


def words(rng, n, pool=5000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text, lang, source of documents with copies, near copies, shared passages, empty, null and long texts."""
    rng = random.Random(4)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(40)]
    passage = words(rng, 70)
    rows = [(i, t, "en", "s0") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(6)]
    for i in range(10):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    for i in range(5):
        rows.append((300 + i, words(rng, 80) + " " + passage + " " + words(rng, 80), "en", "s1"))
    rows += [(400, None, None, "s0"), (401, "", "en", "s0"), (402, " \n\t ", "en", "s0"), (403, "!!! ???", "en", "s0"), (404, "one", "en", "s0"), (405, words(rng, 30_000, 10**6), "en", "s0"), (400, None, None, "s0"), (3, base[3], "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars", *[f"'x' as {c}" for c in EXTRA])
    return df.repartition(3)
