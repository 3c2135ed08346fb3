"""PDF files: syntax, text, tables, and transactions of statements."""

import base64
import datetime as dt
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.pipeline import ingest
from tallyspark.plans import statements
from tallyspark.sources import pdf, pdf_lines

HEADER = ("Trans Date", "Description", "Amount")


def _file(content: bytes, fonts: bytes = b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more: bytes = b"", filters: bytes = b"") -> bytes:
    return (
        b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << %s >> /XObject << /X 9 0 R >> >> >> endobj\n"
        b"4 0 obj << %s /Length 5 0 R >> stream\n%s\nendstream endobj 5 0 obj %d endobj\n%s\ntrailer << /Root 1 0 R >>\n" % (fonts, filters, content, len(content), more)
    )


def _lines(data: bytes) -> list[str]:
    return [r[6] for r in pdf.rows_of(data) if r[2] == "line"]


def _page(content: bytes) -> pdf.Page:
    doc = pdf.Document(_file(content))
    page = pdf.Page(doc)
    page.run(content, {"Font": {"F1": {"Subtype": "Type1", "BaseFont": "Courier"}}})
    return page


def test_values():
    s = pdf.Syntax(rb"<< /A#20b [1 -2.5 .5 (a\(b\)\\(c)\101\n) <48 65 6> true null 3 0 R] % note" + b"\n /C /D >> Tj")
    assert s.value() == {"A b": [1, -2.5, 0.5, b"a(b)\\(c)A\n", b"He`", True, None, pdf.Ref(3)], "C": "D"}
    assert s.value() == "Tj" and s.value() == ""


@pytest.mark.parametrize("packed", [False, True])
def test_statements_are_read(packed):
    rows = [HEADER, ("01/02/1996", "STORE (12)", "$12.50"), ("01/03/1996", "Café \\ bar", "$3.00")]
    data = statements.pdf([statements.page("A title", rows, True), statements.page("Lines", rows[1:], False)], packed)
    found = list(pdf.rows_of(data))
    assert [r[5] for r in found if r[2] == "row"] == [list(r) for r in rows[1:]] and {tuple(r[4]) for r in found if r[2] == "row"} == {HEADER}
    text = [" ".join(r) for r in rows]
    assert [r[6] for r in found if r[2] == "line"] == ["A title", *text, "Questions? Call us", "Lines", *text[1:], "Questions? Call us"]
    assert [r[1] for r in found] == list(range(1, len(found) + 1)) and [r[0] for r in found if r[2] == "line"] == [1] * 5 + [2] * 4
    # references that lead nowhere: the objects are looked for
    assert list(pdf.rows_of(re.sub(rb"startxref\s+\d+", b"startxref\n7", data))) == found
    assert list(pdf.rows_of(data[: data.rindex(b"startxref")])) == found


def test_text_operators():
    content = b"BT /F1 10 Tf 14 TL 1 0 0 1 50 700 Tm (one) Tj T* (two ) Tj [(th) -100 (ree) -2000 (far)] TJ 0 -14 TD (four) Tj (five) ' ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 25 100 Td <736978> Tj ET Q BT /F1 10 Tf 50 150 Td (seven) Tj ET (odd) Td"
    assert _lines(_file(content)) == ["one", "two three far", "four", "five", "six", "seven"]


def test_filters():
    content = b"BT /F1 10 Tf 50 700 Td (some text) Tj ET"
    for name, data in ((b"FlateDecode", zlib.compress(content)), (b"ASCIIHexDecode", content.hex().encode() + b">"), (b"ASCII85Decode", base64.a85encode(content) + b"~>")):
        assert _lines(_file(data, filters=b"/Filter /" + name)) == ["some text"]
    both = base64.a85encode(zlib.compress(content)) + b"~>"
    assert _lines(_file(both, filters=b"/Filter [/ASCII85Decode /FlateDecode]")) == ["some text"]
    with pytest.raises(ValueError, match="JPXDecode"):
        _lines(_file(content, filters=b"/Filter /JPXDecode"))


def test_fonts():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0062> <0005> <0006> [<00e9> <00660069>] endbfrange"
    fonts = (
        b"/F1 << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [<< /DW 500 /W [1 [600 600] 3 4 700] >>] >>"
        b"/F2 << /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [900 900] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /Euro 67 /zero /uni0416 /period] >> >>"
    )
    more = b"7 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (len(cmap), cmap)
    content = b"BT /F1 10 Tf 50 700 Td <000100020003000400050006> Tj /F2 10 Tf 0 -20 Td (ABCDE\xe8) Tj ET"
    assert _lines(_file(content, fonts, more)) == ["Abcdéfi", "é€0Ж.è"]
    page = pdf.Page(doc := pdf.Document(_file(content, fonts, more)))
    page.run(content, doc.get(next(doc.pages())["Resources"]))
    assert [round(c.x1 - c.x0, 3) for c in page.characters[:6]] == [6, 6, 7, 7, 5, 5] and [round(c.x1 - c.x0, 3) for c in page.characters[6:8]] == [9, 9]
    assert [pdf.glyph(n) for n in ("A", "hyphen", "nine", "odieresis", "u1F600", "nothing", "a.sc")] == ["A", "-", "9", "ö", "😀", "", "a"]


def test_forms_are_drawn_in_their_place():
    form = b"BT /F1 10 Tf 0 0 Td (inside) Tj ET"
    more = b"9 0 obj << /Subtype /Form /Matrix [1 0 0 1 50 0] /Length %d >> stream\n%s\nendstream endobj" % (len(form), form)
    assert _lines(_file(b"q 1 0 0 1 0 600 cm /X Do Q BT /F1 10 Tf 10 600 Td (before) Tj ET", more=more)) == ["before inside"]


def test_cells():
    """A grid of rectangles with one cell over two columns, a table beside it, and a box that is no table."""
    word = lambda x, y, t: b"BT /F1 8 Tf %d %d Td (%s) Tj ET " % (x, y, t)
    grid = b"10 10 80 20 re 10 30 40 20 re 50 30 40 20 re S 200 10 30 20 re 200 30 30 20 re S 300 10 50 50 re S "
    content = grid + word(12, 35, b"a") + word(52, 35, b"b") + word(12, 20, b"wide") + word(12, 12, b"cell") + word(202, 35, b"h") + word(202, 15, b"v") + word(310, 20, b"box")
    assert pdf.tables(_page(content)) == [[["a", "b"], ["wide\ncell", None]], [["h"], ["v"]]]


def test_broken_files(spark):
    good = statements.pdf([statements.page("A title", [("01/02/1996", "STORE", "$1.00")], False)])
    files = [("a/1.pdf", good), ("a/2.pdf", b"%PDF-1.4 nothing"), ("a/3.pdf", b""), ("a/4.pdf", None), ("a/5.pdf", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R")), ("a/6.pdf", statements.pdf([statements.page("", [], False).replace(b"(Questions? Call us)", b"(x)")]))]
    df = spark.createDataFrame(files, "path string, content binary")
    errors = {r["path"]: r["line"] for r in pdf.read(df).where("kind = 'error'").collect()}
    assert set(errors) == {f"a/{i}.pdf" for i in (2, 3, 4, 5)} and "no pages" in errors["a/2.pdf"] and "encrypted" in errors["a/5.pdf"]
    rows = pdf_lines.statements(df, 2026).collect()
    assert {(r["source_file"], r["line_no"] > 0, r["problem"]) for r in rows} == {("a/1.pdf", True, None), ("a/6.pdf", False, "no readable text"), *[(p, False, e) for p, e in errors.items()]}
    assert pdf_lines.statements(df.limit(0), 2026).count() == 0


def test_tables_come_before_lines(spark):
    """Per page: a table that gives rows hides the page's lines; one without date or amount, or with bad rows only, doesn't."""
    day = lambda i, t: (f"01/{i:02d}/1996", t, f"${i}.00")
    pages = [
        statements.page("Statement Period: 12/15/1995 - 01/14/1996", [HEADER, day(1, "TABLE"), ("soon", "BAD", "$9.00")], True),
        statements.page("no layout", [("When", "What", "Much"), day(2, "LINE")], True),
        statements.page("bad rows", [HEADER, ("soon", "BAD", "$9.00")], True),
        statements.page("lines", [("1/5", "SHORT", "5.00"), day(3, "LINE")], False),
    ]
    df = spark.createDataFrame([("raw/chase/statements-8147-.pdf", statements.pdf(pages, True))], "path string, content binary")
    rows = pdf_lines.statements(df, 2026).orderBy("line_no").collect()
    assert [(str(r["date"]), r["description"], str(r["amount"]), r["problem"]) for r in rows] == [
        ("1996-01-01", "TABLE", "-1.00", None),
        ("None", "BAD", "-9.00", "bad date"),
        ("1996-01-02", "LINE", "-2.00", None),
        ("1996-01-05", "SHORT", "-5.00", None),
        ("1996-01-03", "LINE", "-3.00", None),
    ]
    assert len({r["line_no"] for r in rows}) == 5 and {r["account"] for r in rows} == {"8147"}


def test_a_statement_is_ingested(spark, tmp_path):
    folder = tmp_path / "raw" / "chase"
    folder.mkdir(parents=True)
    rows = [HEADER, *[(f"01/{i:02d}/2024", f"STORE {i}", f"${i}.25") for i in range(1, 9)]]
    (folder / "statements-8147-.pdf").write_bytes(statements.pdf([statements.page("Statement", rows, True), statements.page("More", rows[1:3], False)], True))
    (folder / "broken.pdf").write_bytes(b"%PDF-1.7 ...")
    got = ingest(spark, [str(tmp_path / "raw")], dt.datetime(2024, 6, 1))
    found = {(str(r["date"]), str(r["amount"]), r["description"], r["institution"], r["account"]) for r in got.transactions.collect()}
    assert found == {(f"2024-01-{i:02d}", f"-{i}.25", f"STORE {i}", "Chase", "8147") for i in range(1, 9)}
    assert {r["file_path"].rsplit("/", 1)[1]: r["success"] for r in got.results.collect()} == {"statements-8147-.pdf": True, "broken.pdf": False}
    assert [r["problem"] for r in got.rejected.collect()] == ["ValueError: no pages"]


def test_statements_are_spread_over_all_tasks(spark):
    """Files of few bytes are as much work as others: they are not put together in a few tasks."""
    rows = spark.range(64).selectExpr("'raw/chase/statements-8147-' || id || '.pdf' as path", "1 as page", "id % 2 = 0 as ruled", "id % 3 = 0 as packed", "1 as nth", "'Title' as title", "array('01/02/2024', 'SHOP', '$1.00') as cells")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        made = statements.written(rows)
        assert made.count() == 64 and made.select(F.spark_partition_id()).distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_an_object_stream_is_opened_once(monkeypatch):
    content, opened = statements.pdf([statements.page("Title", [("a", "b", "c")], True)] * 5, packed=True), []
    given = pdf.Document.content
    monkeypatch.setattr(pdf.Document, "content", lambda self, stream: opened.append(stream.about.get("Type")) or given(self, stream))
    assert len({r[0] for r in pdf.rows_of(content)}) == 5 and opened.count("ObjStm") == 1


def test_dates_of_lines_are_parsed_once_for_each_text(spark, monkeypatch):
    asked = []
    given = pdf_lines.with_text
    monkeypatch.setattr(pdf_lines, "with_text", lambda rows, *more: asked.append(more[0]) or given(rows, *more))
    lines = spark.createDataFrame([("p.pdf", 1, k, f"2024-01-05 Shop{k} $25.99") for k in range(3)], "path string, page int, line_no int, line string")
    assert {(str(r["date"]), str(r["amount"]), r["description"]) for r in pdf_lines.transactions(lines, 2024).collect()} == {("2024-01-05", "-25.99", f"Shop{k}") for k in range(3)} and asked == ["written"]
