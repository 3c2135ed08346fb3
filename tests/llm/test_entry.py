"""The registered queries run, have SQL where they can, and the pipeline does its stages' work."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm import queries, weighted_minhash

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    rows = lambda names, data: sorted(str([r[names.index(n)] for n in sorted(names)]) for r in data)
    assert sorted(df.columns) == sorted(want.columns) and rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[2] < sizes[1] and sizes[4] == sizes[5] and sizes[3] >= 0.9 * sizes[2]
    assert docs.where("not round_trip").count() == 0
    second = spark.read.parquet(str(tmp_path / "1"))
    assert second.count() == weighted_minhash.near_duplicates(second).where("kept").count()
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()} == {tuple(r) for r in docs.select("doc_id", "n_tokens").collect()}


def _through(spark, docs, folder):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        yield docs


def test_pipeline_on_odd_rows(spark, docs, corpus, tmp_path):
    text = {i: t for i, t, *_ in corpus}
    after = list(_through(spark, docs, tmp_path))
    assert all(df.columns == docs.columns for df in after[:-1])
    ids = [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in after]
    # null, empty and letterless texts have no language; every other row stays, repeated ones too
    assert ids[0] == sorted(i for i, t, *_ in corpus if t and any(c.isalpha() for c in t))
    # one row of each class of equal and near-equal texts, the smallest id, the giant text whole
    assert len(set(ids[1])) == len(ids[1]) and not {i for i in ids[1] if 100 <= i < 300} and 405 in ids[1] and 3 in ids[1]
    assert ids[2] == ids[1]
    cut = {r["doc_id"]: r["text"] for r in after[2].select("doc_id", "text").collect()}
    assert all(cut[i] == text[i] for i in cut if not 301 <= i < 305) and all(len(cut[i]) < len(text[i]) for i in range(301, 305))
    assert after[-1].where("not round_trip").count() == 0


def test_pipeline_on_an_empty_table(spark, docs, tmp_path):
    assert [df.count() for df in _through(spark, docs.limit(0), tmp_path)] == [0] * 5


def test_the_rest_works_without_this_folder(tmp_path):
    root = Path(__file__).parents[2]
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'monthly_category_rollup' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
