import io
import re
import zipfile

from casestream.plans.analysis import run_analysis
from casestream.sources import files as Files
from casestream.sources import html as H


def archive(**entries):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return raw.getvalue()


PAGE = """<ul><li class="item row"><a href="/objave/1" target="_blank"> T &amp; 1 </a><a href="?text=1">St-1/2000</a>
<div><small>Sud</small><a href="#"><span>First</span></a></div><div><small>Sud</small><a href="#"><span>Second</span></a></div>
<span class="m-date">1.1.2000.</span><a href="https://h.example/d/preuzimanje">Get</a>
<div><small class="text-muted d-block">Sudionici</small><div class="d-block"><span>Wrong</span></div></div>
<div><small class="text-muted d-block">Sudionici</small><div class="d-block"><span class="badge badge-info">R</span><span> Ana </span>
<small data-original-title="OIB"><sup>OIB</sup> 00000000001</small></div><div class="d-block"><span> </span></div></div></li>
<li class="item row"><a href="/other">no title</a></li></ul>"""


ODD = """<div><ul><li class="x row item"><small class="d-block text-muted">Sudionici</small>
<div class="d-block"><span class="badge">no</span><span>A<b>n</b>a</span><small data-original-title='Adresa'><sup>ADRESA</sup> ADRESA 1</small><div class="d-block"><span>Inner</span></div></div>
<a target=_blank href='objave/../objave/7?a&amp;b'>first</a><a href="//h.example/objave/8" target="_blank"> T\u00a0</a><small>Sud</small><div><a href="/objave-sudova/3">Court<span>S</span></a></div>
<a href="/x/preuzimanje?no">no</a><br><li class="item row"><a href="http://other/objave/9" target="_blank">Nine<p>p<p>q</a><div class="m-date other">d</div><div class="m-date">e</div>
<li class="item">no row</li></ul></div></div><li class="item row"><a href="/objave/10" target="_blank"></a></li><!-- <li class="item row"><a href="/objave/11" target="_blank">c</a></li> -->"""


def entries(spark, html, url="https://h.example/search/a?q=1", full=True):
    df = spark.createDataFrame([(1, url, html), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    return [r.asDict(True) for r in H.html_entries(df, full=full).orderBy("result_pos").collect()]


def test_entry_rules(spark):
    (e,) = entries(spark, PAGE)
    assert (e["title"], e["detail_link"], e["case_number"], e["court"]) == ("T & 1", "https://h.example/objave/1", "St-1/2000", "First")
    assert (e["date"], e["document_download_link"], e["document_link_text"]) == ("1.1.2000.", "https://h.example/d/preuzimanje", "Get")
    assert e["participants"] == [{"name": "Ana", "oib": "00000000001", "address": "N/A", "role": "R"}]


def test_odd_markup(spark):
    one, two, three = entries(spark, ODD)
    assert (one["title"], one["detail_link"], one["court"], one["document_download_link"]) == ("first", "https://h.example/search/objave/7?a&b", "N/A", None)
    assert one["participants"] == [{"name": "Ana", "oib": "N/A", "address": "ADRESA 1", "role": "N/A"}, {"name": "Inner", "oib": "N/A", "address": "N/A", "role": "N/A"}]
    assert (two["title"], two["detail_link"], two["date"], two["case_number"], two["participants"]) == ("Ninepq", "http://other/objave/9", "d", "N/A", [])
    assert (three["title"], three["detail_link"], three["result_pos"]) == ("", "https://h.example/objave/10", 2)
    plain = entries(spark, ODD, full=False)
    assert [(e["court"], e["participants"], e["document_download_link"]) for e in plain] == [("CourtS", [], None), ("N/A", [], None), ("N/A", [], None)]


def test_plain_markup_is_cut_like_any_other():
    plain = '<ul class="a"><li class="item row">a &amp; b > c<li class="m-date x" id="" title="t">d<br>&lt;</b></ul><p>e'
    assert H._PLAIN.fullmatch(plain) and not any(map(H._PLAIN.fullmatch, ("<a href='x'>", "<script>", "<A>", "<br/>", '<a href="?a&amp;b">', "<!-- -->", "a < b")))
    one, two, empty = H._Flat(), H._Flat(), H._Flat()
    one.read(plain)
    two.read(plain + "<!-- -->")
    assert one.array().to_pylist() == two.array().to_pylist() and empty.array().to_pylist() == []


def test_an_item_leaves_its_page_without_the_others(spark):
    """What an item's row carries doesn't grow with its page: the generator drops the page's elements."""
    plan = H.html_entries(spark.createDataFrame([(1, "", "")], "page_id long, url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    (generate,) = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert re.search(r", \[2\], false, \[result_pos#\d+, item#\d+\]", generate)


def test_document_links(spark):
    html = '<a href="/out/preuzimanje">o</a><section id="dokumenti"><div><a href="/a/preuzimanje/1"> A\n b </a></div><a href="/no">n</a><a href="b/preuzimanje">B</a></section><section id="dokumenti"><a href="/c/preuzimanje">c</a></section>'
    df = spark.createDataFrame([(1, "http://h.example/x/y", html), (2, "http://h.example/", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in H.html_links(df).orderBy("link_pos").collect()] == [(1, 0, "http://h.example/a/preuzimanje/1", "A b"), (1, 1, "http://h.example/x/b/preuzimanje", "B")]


def test_script_text_is_no_markup(spark):
    df = spark.createDataFrame([(1, "http://h.example/", '<script>var t="</p><nav><li><a href=x>";</script><nav><ul><li><a href="/a"> A </a></ul></nav>')], "page_id long, url string, html string")
    assert [(r.url, r.text) for r in H.html_links(df, navigation=True).collect()] == [("http://h.example/a", "A")]


def test_archives(spark):
    good = archive(inner__a_dot_txt="hello", b_dot_TXT="x")
    df = spark.createDataFrame([("A.ZIP", bytearray(good)), ("c.txt", bytearray(b"plain")), ("bad.zip", bytearray(b"nope"))], "path string, content binary")
    got = {(r.path, r.entry_name): (r.text, r.error is None) for r in Files.extract_text(Files.expand_archives(df)).collect()}
    assert got[("A.ZIP", "inner/a.txt")] == ("hello", True) and got[("A.ZIP", "b.TXT")] == ("", True)
    assert got[("c.txt", "c.txt")] == ("plain", True) and got[("bad.zip", None)][1] is False
    listing = {r.path: r.status for r in Files.archive_listing(df).collect()}
    assert listing == {"A.ZIP": "success", "c.txt": "error", "bad.zip": "error"}


def test_odd_archives(spark):
    """Stored and deflated entries, folders, a damaged entry, one that is locked, and another method."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("d/", "")
        z.writestr("stored.txt", "plain é")
        z.writestr("packed.txt", "x" * 5000, zipfile.ZIP_DEFLATED)
        z.writestr("bz.txt", "y" * 50, zipfile.ZIP_BZIP2)
        z.writestr("empty.txt", "", zipfile.ZIP_DEFLATED)
    good = raw.getvalue()
    hurt = bytearray(good)
    hurt[good.index(b"plain")] ^= 1  # the stored entry's bytes no longer fit its checksum
    tail = bytearray(b"prefix of another program" + good)
    df = spark.createDataFrame([("good.zip", bytearray(good)), ("hurt.ZIP", hurt), ("tail.zip", tail), ("none.zip", None), ("empty.zip", bytearray(b""))], "path string, content binary")
    for spread in (None, 3):
        got = {(r.path, r.entry_name): (r.entry_pos, r.content and len(r.content), r.error) for r in Files.expand_archives(df, spread=spread).collect()}
        assert got["good.zip", "stored.txt"] == (0, 8, None) and got["good.zip", "packed.txt"] == (1, 5000, None) and got["tail.zip", "packed.txt"] == (1, 5000, None)
        assert got["good.zip", "empty.txt"][2] is None and "method 12" in got["good.zip", "bz.txt"][2] and got["good.zip", "bz.txt"][1] is None
        assert got["hurt.ZIP", "stored.txt"][1] is None and "CRC" in got["hurt.ZIP", "stored.txt"][2] and got["hurt.ZIP", "packed.txt"][2] is None
        assert got["none.zip", None][2] and got["empty.zip", None][2] and len(got) == 14
    listing = {r.path: r.extracted_files for r in Files.archive_listing(df).collect()}
    assert listing["good.zip"] == ["d/", "stored.txt", "packed.txt", "bz.txt", "empty.txt"] and listing["none.zip"] is None


def test_text_by_suffix_and_ocr(spark):
    doc = archive(**{"word__document_dot_xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>A</w:t></w:r></w:p></w:body></w:document>'})

    def texts(rows, **readers):
        df = spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, (n, c) in enumerate(rows)], "i int, entry_name string, content binary")
        return [r.text for r in Files.extract_text(df, **readers).orderBy("i").collect()]

    def pages(content):
        if content == b"!":
            raise OSError
        return ["p1", "p2"]

    assert texts([("x.docx", doc), ("X.DOCX", doc), ("x.docx", b"broken"), ("a.txt", "é".encode() + b"\xff\xe9t"), ("a.TXT", b"t"), (None, b"t"), ("a.txt", None)]) == ["A\n\n", "", "", "é\ufffd\ufffdt", "", "", ""]
    assert texts([("X.PDF", b""), ("x.pdf", b"b"), ("x.pdf", b"!"), ("x.pdf", None), ("x.txt", b" ")], pdf=lambda c: "t" if c == b"b" else " \n", ocr=pages) == ["p1\n\np2\n\n", "t", "", "p1\n\np2\n\n", " "]


def test_whole_analysis(spark):
    schema = "search_term string, result_pos int, title string, case_number string, court string, date string, detail_link string, participants array<struct<name:string,oib:string,address:string,role:string>>, document_download_link string, document_link_text string"
    rows = [("t", 0, "a", "1", "c", "d", "l", None, None, None), ("t", 1, "b", "2", "c", "d", "l", None, "u1", None), ("t", 2, "c", "3", "c", "d", "l", None, "u2", "Docs")]
    content = archive(x_dot_txt="first", y_dot_txt="second")

    def fetch(url):
        if url == "u2":
            raise OSError("gone")
        return content, {"content-type": "application/zip"}

    row = run_analysis(spark.createDataFrame(rows, schema), fetch).first()
    first, second = row.processed_cases
    assert [f.text for f in first.files] == ["x.txt", "y.txt"] and second.files == []
    assert [a.aiResult.summary for a in first.analysis.individualAnalyses] == ["first", "second"]
