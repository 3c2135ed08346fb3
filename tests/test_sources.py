"""Scans and data sources of many files: what the driver holds, and what is listed."""

import pickle

import pytest

from tallyspark.sources import datasource, files


@pytest.fixture
def folder(tmp_path):
    for name in ("a.QFX", "deep/b.qfx", "deep/c d%20e.qfx", "_hidden/x.qfx", ".dot.qfx", "empty.qfx", "z.csv"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("" if name == "empty.qfx" else name)
    return tmp_path / "in"


@pytest.mark.parametrize("recursive", [True, False])
def test_scan_gives_what_spark_gives(spark, folder, recursive):
    got = files.scan(spark, [str(folder)], recursive)
    want = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(str(folder))
    rows = lambda df: sorted((r["path"], r["modificationTime"], r["length"], bytes(r["content"])) for r in df.collect())
    assert got.dtypes == want.dtypes[:4] and rows(got) == rows(want) and len(rows(got)) == (4 if recursive else 2)
    assert sorted(r["length"] for r in files.scan(spark, [f"file://{folder}", str(folder / "deep")], recursive=recursive, ending=".qfx", content=False).collect()) == sorted(r["length"] for r in files.scan(spark, [str(folder), str(folder / "deep")], recursive=recursive, ending="QFX").collect())


def test_scan_lists_in_tasks(spark, folder):
    plan = files.scan(spark, [str(folder)])._jdf.queryExecution().executedPlan().toString()
    assert "binaryfile" not in plan.lower()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan(spark, [str(folder / "none")]).collect()


def test_contents_go_on_in_bounded_batches(spark, folder, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(files, "BATCH_BYTES", 3)
    paths = [f"file:{folder}/{n}" for n in ("a.QFX", "z.csv", "deep/b.qfx")]
    got = list(files._contents(iter([pa.RecordBatch.from_pydict({"path": paths})])))
    assert [b.num_rows for b in got] == [1, 1, 1] and [b["content"][0].as_py() for b in got] == [b"a.QFX", b"z.csv", b"deep/b.qfx"]


def test_the_driver_holds_little_of_many_files(spark, tmp_path):
    df = spark.range(20_000).selectExpr("'raw/a_long_name_of_an_institution/export_' || id || '.qfx' as path", "cast('x' || id as binary) as content")
    writer = datasource.Writer({"path": str(tmp_path / "out")})
    message = writer.write(iter(df.collect()))
    assert len(pickle.dumps(message)) < 1_000 and not (tmp_path / "out/raw/a_long_name_of_an_institution/export_7.qfx").exists()
    other = writer.write(iter(df.limit(3).collect()))
    writer.abort([other, None])
    writer.commit([message, None])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["raw"]
    reader = datasource.Reader({"path": str(tmp_path / "out")}, *datasource.KINDS["tally_files"])
    parts = reader.partitions()
    assert sum(len(pickle.dumps(p)) for p in parts) < 20_000 * 10
    assert sum(len(b) for p in parts for b in reader.read(p)) == 20_000 and len({x for p in parts for x in p.paths}) == 20_000


def test_a_place_written_twice_has_the_last(spark, tmp_path):
    writer = datasource.Writer({"path": str(tmp_path)})
    writer.commit([writer.write(iter([{"path": "a/f", "content": b"1"}, {"path": "a/f", "content": b"2"}, {"path": "g\nh", "content": None}]))])
    assert (tmp_path / "a/f").read_bytes() == b"2" and (tmp_path / "g\nh").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 2
