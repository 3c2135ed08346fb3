"""Files to report: readers, state, sinks, streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark import cli, sinks, state
from tallyspark.model import ACCOUNT
from tallyspark.pipeline import consolidate, ingest, sequenced
from tallyspark.plugins import Parser, built_in
from tallyspark.sources import canonical, csv_files, files, ofx, pdf_lines
from tallyspark.sources.accounts import load_config
from tallyspark.streaming import ingest as streaming

NOW = dt.datetime(2024, 6, 1)


@pytest.fixture
def raw(tmp_path):
    chase, tech = tmp_path / "raw/chase", tmp_path / "raw/first_tech"
    chase.mkdir(parents=True), tech.mkdir(parents=True)
    (chase / "chase1234_a.csv").write_text('Date,Amount,Description,Account\n01/15/2024,-100.50,"Test, one",1234\nbad,1,x,1234\n2024-01-16,-25.00,Another,1234\n2024-01-16,-25.00,Another,1234\n')
    (chase / "b.csv").write_text("Date,Debit,Credit,Description\n2024-01-01,,100.50,Deposit\n2024-01-02,25.00,,Withdrawal\n")
    (tech / "x.qfx").write_text("OFXHEADER:100\nDATA:OFXSGML\n<OFX><STMTRS><ACCTID>123456789\n<BANKTRANLIST><STMTTRN><DTPOSTED>20240105120000\n<TRNAMT>-12.34\n<FITID>F1\n<NAME>PAYEE\n<MEMO>COFFEE\n</STMTTRN><STMTTRN><DTPOSTED>20240106\n<TRNAMT>5.00\n<FITID>F2\n<NAME>REFUND\n</BANKTRANLIST></OFX>\n")
    (tech / "empty.csv").write_text("")
    return tmp_path


def test_header_mapping():
    assert csv_files.mapped(["Date", "Amount", "Description", "Account"]) == {"date": "Date", "amount": "Amount", "description": "Description", "account": "Account"}
    pair = csv_files.mapped(["Date", "Debit", "Credit", "Description"])
    assert pair["debit"] == "Debit" and pair["credit"] == "Credit" and "amount" not in pair
    assert csv_files.missing(csv_files.mapped(["x", "memo"])) == ["date", "amount"]
    assert csv_files.mapped(["Date", "Amount", "memo", "note"], {"description": "note", "account": ["x"]})["description"] == "note"


def test_ingest_consolidate_report(spark, raw):
    accounts = spark.createDataFrame([("chase", "1234", "Main", "credit", None)], ACCOUNT)
    got = ingest(spark, [str(raw / "raw")], NOW, accounts)
    rows = {(str(r["date"]), str(r["amount"]), r["description"], r["account"], r["account_name"]) for r in got.transactions.collect()}
    assert rows == {
        ("2024-01-15", "-100.50", "Test, one", "1234", "Main"), ("2024-01-16", "-25.00", "Another", "1234", "Main"), ("2024-01-01", "100.50", "Deposit", "unknown", "unknown"),
        ("2024-01-02", "-25.00", "Withdrawal", "unknown", "unknown"), ("2024-01-05", "-12.34", "COFFEE", "6789", "6789"), ("2024-01-06", "5.00", "REFUND", "6789", "6789"),
    }
    assert [r["problem"] for r in got.rejected.collect()] == ["bad date"]
    state.Log(spark, str(raw / "state")).append(got.results)
    again = state.load(spark, str(raw / "state"))
    assert again.count() == 3 and again.where("success").count() == 3
    hashed = state.hashed(files.supported(files.scan(spark, [str(raw / "raw")])))
    assert state.to_process(hashed, again).count() == 0 and state.to_process(hashed, again, force=True).count() == 3
    assert [(r["code"], r["category"], r["message"], r["line"]) for r in got.errors.collect()] == [("D001", "data_parsing", "bad date", 2)]
    sinks.write_canonical(got.transactions, str(raw / "data"))
    assert {r["output_file"] for r in sinks.written(spark, str(raw / "data")).collect()} == {r["output_file"] for r in got.results.collect()}
    total = consolidate(spark, str(raw / "data"))
    assert total.count() == 6 and total.where("account_name = 'Main'").count() == 2
    sinks.write_consolidated(total, str(raw / "data/total"))
    assert canonical.combined(spark, str(raw / "data/total")).count() == 6
    page = sinks.html_report(total.withColumn("description", F.lit("</script>")), details=str(raw / "details"))
    assert "2024-01" in page and page.count("</script>") == 1 and str(raw / "details") in page
    assert spark.read.option("header", True).csv(str(raw / "details")).count() == 6
    assert state.history(again, NOW, 30, "chase").count() == 2 and state.cleaned(again, again.limit(0), NOW + dt.timedelta(100)).count() == 0


def test_a_changed_file_replaces_its_output(spark, raw):
    args = lambda *more: ["--state", str(raw / "s"), "process", str(raw / "raw"), "-o", str(raw / "data"), "--accounts", str(raw / "none.yaml"), *more]
    total = lambda: sorted(str(r["amount"]) for r in consolidate(spark, str(raw / "data")).collect())
    cli.main(args("--batch", "2", "--errors", str(raw / "errors")), spark)
    first = total()
    assert len(first) == 6 and spark.read.json(str(raw / "errors/report")).first()["warnings"] == 1
    assert cli.main(args(), spark) is None and total() == first  # nothing has changed
    (raw / "raw/chase/b.csv").write_text("Date,Debit,Credit,Description\n2024-01-01,,777.00,Deposit\n")
    # a file of the same name in another folder has its own output
    (raw / "raw/chase/more").mkdir()
    (raw / "raw/chase/more/b.csv").write_text("Date,Amount,Description\n2024-02-01,-5.00,Other\n")
    assert cli.main(args(), spark).first()["total_files"] == 2
    assert total() == sorted([x for x in first if x not in ("100.50", "-25.00")] + ["-25.00", "777.00", "-5.00"])
    # a file whose output is gone is processed again
    gone = next(p for p in (raw / "data").rglob("__file=x.qfx*"))
    for p in sorted(gone.rglob("*"), reverse=True):
        p.unlink()
    assert cli.main(args(), spark).first()["total_files"] == 1 and len(total()) == 6


def test_one_parser_reads_a_file(spark, raw):
    def fixed(spark, files):
        rows = csv_files.read(spark, files.limit(0))
        one = files.select(F.col("path").alias("source_file"), F.lit(1).alias("line_no"), F.lit("2024-03-03").cast("date").alias("date"), F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit("FIXED").alias("description"), F.lit("9").alias("account"), F.lit("Chase").alias("institution"), *[F.lit(None).cast("string").alias(c) for c in ("transaction_id", "category")], F.lit(None).cast("decimal(18,2)").alias("balance"), F.lit(None).cast("string").alias("problem"))
        return one.select(rows.columns)

    registry = built_in(2024)
    assert registry.register(Parser("special", fixed, (".csv",), 5, ("chase",), lambda path: path.endswith("/b.csv")))
    assert not registry.register(Parser("special", fixed, (".csv",), 5))
    got = ingest(spark, [str(raw / "raw")], NOW, registry=registry)
    by = {}
    for r in got.transactions.collect():
        by.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r["description"])
    assert sorted(by["b.csv"]) == ["FIXED"] and sorted(by["chase1234_a.csv"]) == ["Another", "Test, one"] and len(by["x.qfx"]) == 2


def test_configuration_reaches_the_flow(spark, raw, tmp_path):
    (raw / "raw/odd").mkdir()
    (raw / "raw/odd/o.csv").write_text("When,Amount,note,Description\n01.02.2024,-3.00,Kept,Dropped\n")
    (tmp_path / "c.json").write_text('{"date_formats": ["dd.MM.yyyy"], "column_overrides": {"date": "When", "description": "note"}, "institution_mappings": {"odd": "even bank"}}')
    config, wrong = load_config(str(tmp_path / "c.json"))
    assert wrong == []
    got = ingest(spark, [str(raw / "raw/odd")], NOW, config=config)
    assert [(str(r["date"]), r["description"], r["institution"]) for r in got.transactions.collect()] == [("2024-02-01", "Kept", "Even Bank")]
    assert ingest(spark, [str(raw / "raw/odd")], NOW, state=got.results, config=config, outputs=got.results.select("output_file")) is None
    config.skip_processed = False
    assert ingest(spark, [str(raw / "raw/odd")], NOW, state=got.results, config=config).transactions.count() == 1


def test_pdf_tables(spark):
    rows = [
        ("raw/chase/statements-8147-.pdf", 1, 0, 1, ["Date", "Description", "Amount", "Balance"], ["10/15/2024", "COFFEE SHOP", "$3.50", "100.00"]),
        ("raw/chase/statements-8147-.pdf", 1, 0, 2, ["Date", "Description", "Amount", "Balance"], ["", "Carried over", "1.00", None]),
        ("raw/chase/statements-8147-.pdf", 1, 1, 1, ["Item", "Value"], ["10/15/2024", "1.00"]),
        ("raw/chase/statements-8147-.pdf", 2, 0, 1, ["Posting Date", "Payee", "Credit"], ["2024-10-16", "PAYMENT THANK YOU", "20.00"]),
        ("raw/chase/statements-8147-.pdf", 2, 0, 2, ["Posting Date", "Payee", "Credit"], ["2024-10-16"]),
        ("raw/chase/statements-8147-.pdf", 2, 0, 3, None, None),
    ]
    rows = [(path, page, n, header, cells) for n, (path, page, _, _, header, cells) in enumerate(rows, 1)]
    df = spark.createDataFrame(rows, "path string, page int, line_no int, header array<string>, cells array<string>")
    got = [(r["line_no"], str(r["date"]), str(r["amount"]), str(r["balance"]), r["account"]) for r in pdf_lines.table_transactions(df).orderBy("line_no").collect()]
    assert got == [(1, "2024-10-15", "-3.50", "100.00", "8147"), (4, "2024-10-16", "20.00", "None", "8147")]
    assert pdf_lines.table_transactions(df.limit(0)).count() == 0


def test_strict_reader_names_the_row(spark, tmp_path):
    (tmp_path / "d/bank").mkdir(parents=True)
    (tmp_path / "d/bank/f.csv").write_text("date,amount,description,account,institution,transaction_id,category\n2024-01-01,1.00,a,1,b,,\n2024-01-02,x,a,1,b,,\n")
    found = canonical.discovered(spark, str(tmp_path / "d"))
    with pytest.raises(Exception, match="line 2 field amount"):
        canonical.read_strict(spark, found).collect()
    (tmp_path / "e/bank").mkdir(parents=True)
    (tmp_path / "e/bank/f.csv").write_text("date,amount\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        canonical.read_strict(spark, canonical.discovered(spark, str(tmp_path / "e")))


def test_formats_and_ofx(spark, raw):
    all_files = files.scan(spark, [str(raw / "raw")])
    assert {(r["format"], r["n_files"]) for r in files.by_format(all_files).collect()} == {("csv", 2), ("qfx", 1)}
    assert ofx.read(files.scan(spark, [str(raw / "raw")], ending=".QFX")).count() == 2


def test_pdf_lines(spark):
    lines = [(1, 0, "Opening/Closing Date 12/19/23 - 01/18/24"), (1, 1, "12/20 Amazon.com Amzn.com/bill WA -3.86"), (1, 2, "01/02 AMAZON MKTPL*X 52.20"), (1, 3, "This is just regular text"), (2, 4, "2024-01-05 Purchase at store $25.99")]
    df = spark.createDataFrame([("raw/chase/statements-8147-.pdf", *x) for x in lines], "path string, page int, line_no int, line string")
    got = [(str(r["date"]), str(r["amount"]), r["account"], r["institution"]) for r in pdf_lines.transactions(df, 2030).orderBy("line_no").collect()]
    assert got == [("2023-12-20", "3.86", "8147", "Chase"), ("2024-01-02", "-52.20", "8147", "Chase"), ("2024-01-05", "-25.99", "8147", "Chase")]
    assert pdf_lines.table_columns(["Date", "Description", "Amount", "Balance"]) == {"date": 0, "description": 1, "amount": 2, "balance": 3}
    assert pdf_lines.table_columns(["Date", "Description", "Balance"]) is None


def test_sequence_follows_files_and_lines(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("a", 2)], "source_file string, line_no int")
    assert [tuple(r) for r in sequenced(df).orderBy("txn_seq").select("source_file", "line_no", "txn_seq").collect()] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3), ("b", 2, 4)]


def test_streamed_clusters(spark, tmp_path):
    rows = [(1, "f", dt.date(2024, 1, 1), "A"), (2, "f", dt.date(2024, 1, 4), "A"), (3, "f", dt.date(2024, 1, 8), "A"), (4, "f", dt.date(2024, 3, 1), "B")]
    df = spark.createDataFrame(rows, "txn_seq long, source_file string, date date, account string").selectExpr("txn_seq", "source_file", "date", "cast(5 as decimal(18,2)) as amount", "'COFFEE' as description", "account", "'b' as institution", "cast(null as string) as transaction_id", "cast(null as string) as category", "cast(null as decimal(18,2)) as balance", "account as account_name", "'debit' as account_type")
    df.write.parquet(str(tmp_path / "in"))
    streaming.start(streaming.clusters(streaming.canonical_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["n"], r["first_seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 3), (2, 1)]


def test_cli(spark, raw, capsys):
    cli.main(["--state", str(raw / "s"), "process", str(raw / "raw"), "-o", str(raw / "data"), "--accounts", str(raw / "none.yaml")], spark)
    assert cli.main(["--state", str(raw / "s"), "import", "-d", str(raw / "data"), "-o", str(raw / "all")], spark).count() == 6
    assert cli.main(["--state", str(raw / "s"), "status"], spark).first()["total_files"] == 3
    assert cli.main(["--state", str(raw / "s"), "cleanup", "--days", "0"], spark).count() == 3
    cli.main(["report", "-d", str(raw / "data"), "-o", str(raw / "html")], spark)
