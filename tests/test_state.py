"""The state's log: commits, retries, compaction; files that change; a stream that repeats a batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyspark import pipeline, sinks, state
from tallyspark.model import FILE_STATE
from tallyspark.sources import files as file_sources
from tallyspark.streaming import ingest as streaming

NOW = dt.datetime(2024, 6, 1)


def _rows(spark, some, at=NOW):
    return spark.createDataFrame([(f"f{i}", f"h{i}", at, f"o{i}", n, n > 0, None, 1, "bank", at) for i, n in some], FILE_STATE)


def _read(log):
    return {r["file_path"]: r["transaction_count"] for r in log.read().collect()}


def test_batches_append_their_own_rows(spark, tmp_path):
    log = state.Log(spark, str(tmp_path / "s"))
    assert _read(log) == {} and not log.committed("a", 0)
    log.append(_rows(spark, [(i, 1) for i in range(50)]))
    log.append(_rows(spark, [(1, 5), (99, 7)], NOW - dt.timedelta(1)))
    assert _read(log) == dict.fromkeys((f"f{i}" for i in range(50)), 1) | {"f1": 5, "f99": 7}
    tables = [spark.read.parquet(str(tmp_path / "s" / c["table"])).count() for c in log.commits()]
    assert tables == [50, 2]


def test_a_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    log = state.Log(spark, str(tmp_path / "s"))
    log.append(_rows(spark, [(1, 1)]))
    bad = _rows(spark, [(1, 2)]).withColumn("file_hash", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        log.append(bad)
    assert _read(log) == {"f1": 1}
    # a commit that was broken off while it was written is none; the next one has the number after it
    (tmp_path / "s/_log/000000000001.json").write_text('{"version": 1, "tab')
    assert _read(log) == {"f1": 1}
    log.append(_rows(spark, [(1, 3)]))
    assert _read(log) == {"f1": 3} and [c["version"] for c in log.commits()] == [0, 2]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    log = state.Log(spark, str(tmp_path / "s"))
    for number, some in ((0, [(1, 1)]), (0, [(1, 9)]), (1, [(2, 2)]), (0, [(1, 9)]), (1, [(2, 9)])):
        log.append(_rows(spark, some), "stream", number)
    log.append(_rows(spark, [(3, 3)]), "other", 0)
    assert _read(log) == {"f1": 1, "f2": 2, "f3": 3} and len(log.commits()) == 3


def test_compaction_keeps_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MOST", 3)
    log = state.Log(spark, str(tmp_path / "s"))
    for k in range(9):
        log.append(_rows(spark, [(k, k), (0, 100 + k)]), "stream", k)
    assert _read(log) == {f"f{k}": k for k in range(1, 9)} | {"f0": 108} and log.committed("stream", 8) and not log.committed("stream", 9)
    assert len(log.current()) <= 4 and len([p for p in os.listdir(tmp_path / "s") if p.startswith("t-")]) == len(log.commits()) <= 9
    log.replace(log.read().where("file_path = 'f3'"))
    assert _read(log) == {"f3": 3} and log.committed("stream", 8)


def _write(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("Date,Amount,Description,Account\n" + "".join(f"2024-01-{d:02d},{a},{t},1234\n" for d, a, t in rows))


def _amounts(spark, out):
    return sorted((r["description"], str(r["amount"])) for r in pipeline.consolidate(spark, str(out)).collect())


def test_only_changed_files_are_read(spark, tmp_path):
    raw = tmp_path / "raw/chase"
    _write(raw, "a.csv", (1, "-1.00", "Coffee"))
    _write(raw, "b.csv", (2, "-2.00", "Bread"))
    listing = file_sources.scan(spark, [str(tmp_path / "raw")]).select("path", "modificationTime", "length")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[1]
    first = pipeline.ingest(spark, [str(tmp_path / "raw")], NOW)
    log = state.Log(spark, str(tmp_path / "s"))
    log.append(first.results)
    assert state.unsettled(listing, log.read()).count() == 0
    os.utime(raw / "a.csv", (2_000_000_000, 2_000_000_000))  # written again, the same
    _write(raw, "b.csv", (2, "-2.50", "Bread"))
    os.utime(raw / "b.csv", (2_000_000_000, 2_000_000_000))
    assert state.unsettled(listing, log.read()).count() == 2
    second = pipeline.ingest(spark, [str(tmp_path / "raw")], NOW, state=log.read())
    assert [r["file_path"][-5:] for r in second.results.collect()] == ["b.csv"] and [r["file_path"][-5:] for r in second.touched.collect()] == ["a.csv"]
    log.append(second.results.unionByName(second.touched))
    assert state.unsettled(listing, log.read()).count() == 0 and pipeline.ingest(spark, [str(tmp_path / "raw")], NOW, state=log.read()) is None


def test_a_stream_counts_each_file_once(spark, tmp_path, monkeypatch):
    raw, out, paths = tmp_path / "raw/chase", tmp_path / "data", (str(tmp_path / "s"), str(tmp_path / "c"))
    run = lambda: streaming.follow(spark, str(tmp_path / "raw"), str(out), *paths, now=lambda: NOW).awaitTermination(300)
    _write(raw, "a.csv", (1, "-1.00", "Coffee"))
    run()
    assert _amounts(spark, out) == [("Coffee", "-1.00")]
    # a batch that fails after its files are written is run again, under its number, and doubles nothing
    _write(raw, "b.csv", (2, "-2.00", "Bread"), (3, "-3.00", "Milk"))
    real = state.Log.append
    monkeypatch.setattr(state.Log, "append", lambda *args: (_ for _ in ()).throw(RuntimeError("lost before the commit")))
    with pytest.raises(Exception, match="lost before the commit"):
        run()
    monkeypatch.setattr(state.Log, "append", real)
    log = state.Log(spark, paths[0])
    assert log.read().count() == 1
    run()
    want = [("Bread", "-2.00"), ("Coffee", "-1.00"), ("Milk", "-3.00")]
    assert _amounts(spark, out) == want and log.read().count() == 2 and log.committed("follow", 1)
    # a known file that changes is taken with the next batch, or by catching up
    _write(raw, "a.csv", (1, "-1.50", "Coffee"))
    os.utime(raw / "a.csv", (2_000_000_000, 2_000_000_000))
    _write(raw, "c.csv", (4, "-4.00", "Soap"))
    run()
    assert _amounts(spark, out) == [("Bread", "-2.00"), ("Coffee", "-1.50"), ("Milk", "-3.00"), ("Soap", "-4.00")]
    _write(raw, "c.csv", (4, "-4.50", "Soap"))
    os.utime(raw / "c.csv", (2_000_000_100, 2_000_000_100))
    assert streaming.catch_up(spark, str(tmp_path / "raw"), str(out), paths[0], lambda: NOW) and not streaming.catch_up(spark, str(tmp_path / "raw"), str(out), paths[0], lambda: NOW)
    assert ("Soap", "-4.50") in _amounts(spark, out) and log.read().where("success").count() == 3


def test_export_is_in_order(spark, tmp_path):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta((i * 37) % 200), f"t, \"{i}\"") for i in range(500)]
    df = spark.createDataFrame(rows, "txn_seq long, date date, description string").selectExpr("*", "cast(1 as decimal(18,2)) as amount", "'a' as account", "'b' as institution", "cast(null as string) as transaction_id", "'' as category", "cast(null as decimal(18,2)) as balance").repartition(3)
    sinks.write_consolidated(df, str(tmp_path / "e"), str(tmp_path / "one/all.csv"))
    one = (tmp_path / "one/all.csv").read_text().splitlines()
    assert len(one) == 501 and one[0].startswith("date,amount,") and [r[:10] for r in one[1:]] == sorted(r[:10] for r in one[1:])
    parts = spark.read.json(str(tmp_path / "e/_manifest")).orderBy("part").collect()
    assert len(parts) > 1 and sum(r["rows"] for r in parts) == 500 and all(a["last"] <= b["first"] for a, b in zip(parts, parts[1:]))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 500
