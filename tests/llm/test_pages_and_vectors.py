"""Operators on pages and embeddings against brute force, and their defined results for odd rows."""

import base64
import hashlib
import html as html_lib
import io
import math
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import multi_index, product_quantisation, style_tree, url_rules, warc_zip

PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy</div><article><h1>Head {i}</h1><p>One &amp; <b>two</b>{i}<br>three<p>Four<div class="comments">Nice!</div></article><footer>&copy;</footer>'


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as path", "'z' as nodes", "'s' as sha1").repartition(3)


def test_main_text(spark):
    rows = [(i, f"http://a.example.org/{i}", PAGE.format(i=i)) for i in range(12)]
    rows += [(100, None, None), (101, "http://a.example.org/", ""), (102, "http://b.org", "plain &lt;text&gt;\n only"), (103, "http://b.org", "<article>un <b>closed &nbsp; x <div hidden>no</div>"), (0, rows[0][1], rows[0][2]), (104, "http://c.org", "<article>" + "word " * 60_000), (105, "x", "<p>a</p><form>f</form><!-- c <p>z</p>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in style_tree.extracted(pages(spark, rows)).collect()]
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert all(by[i] == f"Head {i} One & two{i} three Four" for i in range(12))
    assert by[100] == by[101] == "" and by[102] == "plain <text> only" and by[103] == "un closed x" and len(by[104]) == 60_000 * 5 - 1 and by[105] == "a"
    assert style_tree.extracted(pages(spark, rows).limit(0)).count() == 0


def test_entropy_removes_what_all_pages_of_a_host_have(spark):
    html = "<body><div class=x1>Same on every page</div><div class=y2><p>Story {i} of many</p></div></body>"
    rows = [(i, f"http://h.org/{i}", html.format(i=i)) for i in range(20)] + [(50, "http://other.org/", html.format(i=50).replace("x1", "z").replace("y2", "w"))]
    got = {r["page_id"]: r["text"] for r in style_tree.extracted(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i} of many" for i in range(20)) and got[50] == "Same on every page Story 50 of many"
    values = [r["importance"] for r in style_tree.importance(pages(spark, rows[:20]).select("html").withColumn("host", style_tree.F.lit("h"))).collect()]
    # by hand: a node of one presentation has 0.9 times the importance of its texts, which is 0 for the box and 1 for the stories
    assert sorted(round(v, 9) for v in values) == [0.0, 0.9]


def test_entropy_removes_repeated_boxes_inside_articles(spark):
    html = "<body><article><h1>Head {i}</h1><div class=x9>Same box</div><p>Story {i}</p></article></body>"
    rows = [(i, f"http://h.org/{i}", html.format(i=i)) for i in range(20)] + [(50, "http://other.org/", html.format(i=50).replace("x9", "z"))]
    got = {r["page_id"]: r["text"] for r in style_tree.extracted(pages(spark, rows)).collect()}
    assert all(got[i] == f"Head {i} Story {i}" for i in range(20)) and got[50] == "Head 50 Same box Story 50"


def test_importance_matches_entropies_by_hand(spark):
    texts = ["a", "a", "a", "b", "c", "d"]
    html = [f"<body><div class=q>{t}{'<p>x</p>' * (k % 2)}</div></body>" for k, t in enumerate(texts)]
    df = spark.createDataFrame([("h", t) for t in html], "host string, html string")
    got = {r["pages"]: r["importance"] for r in style_tree.importance(df).collect()}
    content = (3 + 1 - math.log(3) / math.log(6)) / 4
    assert abs(got[6] - (0.9**2 * content + (1 - 0.9**2) * math.log(2) / math.log(6))) < 1e-9


def test_the_tree_alone_finds_the_article_on_given_pages(spark):
    """Word lists, tags of menus and the rule for article elements are switched off: entropies alone remove menus, adverts and footers."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    article = lambda html: "".join(html_lib.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", html, re.S)[1])).split())
    want = {r["page_id"]: article(r["html"]) for r in given.collect()}
    got = {r["page_id"]: "".join(r["text"].split()) for r in style_tree.extracted(given, marks=False).collect()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98
    assert {r["page_id"]: "".join(r["text"].split()) for r in style_tree.extracted(given).collect()} == want


def test_copies_of_a_page_do_not_make_it_a_menu(spark):
    page = lambda i: f"<body><div class=m>Menu</div><div class=t>{''.join(f'<p>Text {i} {k}</p>' for k in range(9))}</div></body>"
    rows = [(i, f"http://h.org/{i}", page(0)) for i in range(60)] + [(100 + i, f"http://h.org/x{i}", page(i + 1)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in style_tree.extracted(pages(spark, rows)).collect()}
    assert all(got[i] == " ".join(f"Text {max(0, i - 99)} {k}" for k in range(9)) for i in got) and len(got) == 72


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>Story<svg><p>goes on", "Story goes on"),
        ("<p>A <select><option>x</option></select> b <button>press", "A b press"),
        ("<iframe src=x><p>Text after", "Text after"),
        ('<p>One <span class="ad">Buy <span>now</span></span> two</p>', "One two"),
        ('<p>One <span class="ad">Buy</p><p>Two</p>', "One Two"),
        ('<div class="share-price"><p>Shares rose</p></div>', "Shares rose"),
        ('<div class="share-buttons"><p>Share this</p></div><p>x</p>', "x"),
        ('<div class="ad-slot">Buy</div><div class="story has-ads">Text</div>', "Text"),
        ('<div id="top"><p>Text</p></div><header>Head</header>', "Text"),
        ("<head><title>T</title><p>No end of head</p>", "No end of head"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a b c d"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<p>a &amp;amp; b &lt;i&gt; &#x41;&#66; &nosuch;</p>", "a &amp; b <i> AB &nosuch;"),
        ("<p>a<br>b<hr>c</p>", "a b c"),
        ("<!-- x --><p>a<!-- <p>b</p> -->c</p><!-- open", "ac"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>if (a < b) '</p>'</script><p>t</p><script>open", "t"),
        ("<textarea><p>typed</p></textarea><p>t", "t"),
        ("<noscript><p>off</p></noscript><p>t</p>", "t"),
        ("<template><p>off</p></template><p>t</p>", "t"),
        ("<p hidden>h</p><p aria-hidden=true>h</p><p style='display: none'>h</p><p>t</p>", "t"),
        ("<div role=navigation>menu</div><div role=main>t</div>", "t"),
        ("<aside>s</aside><form>f</form><dialog>d</dialog><p>t</p>", "t"),
        ("<div class=cookie-notice>c</div><div class=newsletter>n</div><p>t</p>", "t"),
        ("<article><p>t</p><section id=comments><p>c</p></section></article>", "t"),
        ("<main><h1>H</h1><p>t</p></main><p>beside</p>", "H t"),
        ("<P>UP</P><DIV CLASS=AD>x</DIV>", "UP"),
        ("<pre>a\n   b</pre><blockquote>q</blockquote>", "a b q"),
        ("<article><p>Keep one</p><!-- old: <script> --><p>Keep two</p></article>", "Keep one Keep two"),
        ("<html><head><title>Never closed<body><article><p>All of it</p></article>", "All of it"),
        ("<article><p>one</p><textarea><p>two</p></article>", "one two"),
        ("<article><p>one</p><script>var a = '<!--';</script><p>two</p><style>p {}<p>three</p></article>", "one two three"),
        ("<p>İİİİ</p><svg><p>x</p>", "İİİİ x"),
        ("<p>a</p><titles>b</titles>", "a b"),
        ("plain text", "plain text"),
        ("", ""),
        ("<a href='x", ""),
    ],
)
def test_odd_pages(html, want):
    assert style_tree.main_text(html, frozenset()) == want


def test_marks_around_the_article_count_for_nothing():
    text = lambda html: style_tree.main_text(html, frozenset())
    for top in ('<body id="top">', '<body class="has-sidebar">', '<body class="custom-header">', '<body class="comments-open">', '<body><div class="with-sidebar">'):
        assert text(f"<html>{top}<nav>menu</nav><article><p>Real</p><div class=comments>c</div></article><aside>a</aside>") == "Real", top
    assert text("<main></main><div><p>Real</p></div><nav>menu</nav>") == "Real"
    assert text("<div><p>Real text of some length</p></div><article>One</article><article>Two</article>") == "Real text of some length One Two"
    assert text("<article>Real</article><div class=related><article>card</article></div><aside><article>card</article></aside>") == "Real"
    assert text("<div class=sidebar-left><main>Real</main></div><article>card</article>") == "Real card"
    assert text("<html><head><title>T</title><meta charset=utf-8><style>p</style><body><p>Real</p>") == "Real"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/4", ""), (6, "http://a/6\r\nX: y", "é" * 70_000), (7, "http://a/7", "x\r\n\r\ny"), (2, "http://a/2", "same")]
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zip.round_trip(spark, pages(spark, rows)).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i, len((h or "").encode()), digest(h), "revisit" if first[h or ""] < i else "response", first[h or ""] if first[h or ""] < i else None) for i, _, h in rows)
    assert got == want
    assert warc_zip.round_trip(spark, pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("full", [1, 3000, 64 << 20])
def test_a_task_with_more_than_one_archive_writes_every_record(tmp_path, monkeypatch, full):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", full)
    html = ["".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(4)) for i in range(60)]
    sha1 = [hashlib.sha1(t.encode()).hexdigest() for t in html]
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["http://a/"] * 60), pa.array(html), pa.array(sha1), pa.array([None] * 60, pa.int64())], ["page_id", "url", "html", "sha1", "refers_to"])
    archives = list(warc_zip._writer(f"file:{tmp_path}")(iter([rows.slice(0, 7), rows.slice(7, 0), rows.slice(7, 30), rows.slice(37)])))
    assert len({b["uri"][0].as_py() for b in archives}) == len(archives) and sum(b["records"][0].as_py() for b in archives) == 60
    assert {1: len(archives) == 60, 3000: 2 < len(archives) < 30}.get(full, len(archives) == 1)
    got = [r for b in warc_zip._ranges(warc_zip._planned(iter(archives))) for r in b.to_pylist()]
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in got] == [(i, 512, base64.b32encode(bytes.fromhex(h)).decode(), "response") for i, h in enumerate(sha1)]


def test_zip_directory_reads_what_zipfile_writes(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("é/small", b"abc")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    with pa.OSFile(str(path)) as f:
        found = warc_zip.directory(f)
        assert set(found) == {"big", "é/small"}
        for name, want in (("big", b"0123456789"), ("é/small", b"abc")):
            f.seek(found[name][0])
            assert f.read(found[name][1]) == want
    with pytest.raises(ValueError):
        warc_zip.directory(pa.BufferReader(b"not a zip"))


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(6):
            z.writestr(f"m{i}", str(i))
    f = pa.BufferReader(raw.getvalue())
    found = warc_zip.directory(f)
    assert len(found) == 6 and b"PK\x06\x06" in raw.getvalue()


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rows_in_range", [7, 10**9])
def test_url_rules(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(url_rules, "RANGE_ROWS", rows_in_range)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "xexample.org", "example.com", "M.Example.COM", "org", "net", "a,b.org", ""]
    paths = ["", "/", "/es/1", "/es", "/en/12", "/en/2", "/fr/x?y=1", "/de/#f", "?q=/fr/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no host", "http://", "ftp://example.org/es/1?x://y"] + ["http://a.example.org/es/1"] * 60 + ["http://example.org/" + "z" * 70_000, "http:///foo", "http:///bar", "http:///", "http://a./foo"]
    rules = [*url_rules.RULES, ("a.example.org", "/es/", "allow"), ("org", "/es/1", "block"), ("", "/foo", "block"), ("", "", "block"), ("com", "", "block"), ("example.com", "/en/12", "allow")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'k' as key")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(df, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judged(df.limit(0), url_rules.rules_table(spark)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[100:130] = x[7] + rng.normal(size=(30, 16)) * 0.05  # one dense group
    x[200:260] = x[8]  # copies
    x[300] = x[8] * 2.5
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if not 100 <= i < 301 else 1) for i in range(900)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0] * 5, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [1.0] * 15, 1), (2005, [None] + [1.0] * 15, 1), (2006, rows[200][1], None), (200, rows[200][1], 1), (2020, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as v", "'c' as cell", "1 as n").repartition(3), rows


def usable(rows):
    return [(i, np.array(v, dtype=np.float32).astype(float), k) for i, v, k in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]


def test_nearest_neighbours(spark, vectors, monkeypatch):
    df, rows = vectors
    good = usable(rows)
    ids, x = np.array([i for i, *_ in good]), np.stack([v for _, v, _ in good])
    for share, block, together in ((1.0, 16_384, 256), (multi_index.SHARE, 64, 7)):
        monkeypatch.setattr(multi_index, "BLOCKS", (min(block, 2_048), block))
        monkeypatch.setattr(multi_index, "TOGETHER", together)
        got = multi_index.neighbours(df, "vec_id % 20 = 0", share=share).collect()
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
        recall = []
        for q, found in by.items():
            found.sort()
            score = x @ x[np.flatnonzero(ids == q)[0]]
            order = [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q]
            best = sorted(order)[:20]
            assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len(found) == 20
            assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(abs(f[2] - score[np.flatnonzero(ids == f[1])[0]]) < 1e-9 for f in found)
            recall.append(np.mean([(f[2] >= -best[-1][0] - 1e-9) for f in found]))
            if share == 1:  # all are candidates
                assert [f[1] for f in found] == [i for _, i in best] or np.allclose([f[2] for f in found], [-s for s, _ in best])
        assert np.mean(recall) >= (0.9 if share < 1 else 1.0)
    assert multi_index.neighbours(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_many_rows_of_few_ids(spark):
    """60,000 rows that share three ids, some of them equal: no id's hash decides whether an index is learned, and all queries are answered."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60_000, 8))
    x[:20_000] = x[0]
    df = spark.createDataFrame([(20 * int(i % 3), v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = multi_index.neighbours(df, "vec_id % 20 = 0").collect()
    assert len(got) == 60 and {r["query_id"] for r in got} == {0, 20, 40} and all(r["query_id"] != r["vec_id"] for r in got)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 1)] * 40_000, "vec_id long, embedding array<float>")
    assert [r["rank"] for r in multi_index.neighbours(same, "vec_id % 20 = 0").orderBy("rank").collect()] == list(range(1, 21))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    given = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    good = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in given.collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    by = {}
    for r in multi_index.neighbours(given, "vec_id % 20 = 0").collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.where(np.arange(len(ids)) == q, -np.inf, x @ x[q])
        recall.append(np.mean([i in by[ids[q]] for i in ids[np.lexsort((ids, -score))[:20]].tolist()]))
    assert np.mean(recall) >= 0.9


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(7), rng.random(5), [1] * 35
    seen = multi_index.visited(a, b, counts, 35)
    total = [a[c // 5] + b[c % 5] for c in seen]
    assert sorted(seen) == list(range(35)) and total == sorted(total) and len(multi_index.visited(a, b, counts, 9)) == 9


@pytest.mark.parametrize("block", [2_048, 16])
def test_near_duplicate_vectors(spark, vectors, monkeypatch, block):
    df, rows = vectors
    monkeypatch.setattr(product_quantisation, "BLOCK", block)
    monkeypatch.setattr(product_quantisation, "QUERIES", block)
    good = {i: (v / np.linalg.norm(v), k) for i, v, k in usable(rows) if k is not None}
    ids = sorted(good)
    links = {i: set() for i in {r[0] for r in rows}}
    for a in ids:
        for b in ids:
            if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.98:
                links[a].add(b), links[b].add(a)
    part = {}
    for i in sorted(links):
        if i not in part:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in part:
                    part[j] = i
                    todo += links[j]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in product_quantisation.near_duplicates(df).collect()}
    assert got == {i: (len(links[i]), part[i], part[i] == i) for i in links}
    assert product_quantisation.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0, 0.1], 5), (1, [1.0, 0.0, 0.11], 5), (2, [1.0, 0.0, 0.12], 5), (1, [1.0, 0.0, 0.1], 5), (3, [0.0, 1.0, 0.0], 5), (4, [0.0, 1.0, 0.01], 5), (3, [0.0, 0.0, 1.0], 5), (0, [0.0, 0.01, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in product_quantisation.near_duplicates(df).collect()}
    # the vectors of 1 link with each other and with 2; those of 3 don't, but 4 and 0 meet in it
    assert got == {1: (4, 1, True), 2: (2, 1, False), 3: (2, 0, False), 4: (1, 0, False), 0: (1, 0, True)}
