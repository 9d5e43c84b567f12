"""Known inputs and outputs of the document operators, broken and hostile packages, and whole batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import blocks as B
from leafmill.functions import html as H
from leafmill.functions import markdown as M
from leafmill.functions import scalars as S
from leafmill.operators import convert, grid, headings
from leafmill.sinks.files import write_folders
from leafmill.sources import docx, samples, xlsx
from leafmill.streaming import incremental


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_scalars(spark):
    assert column(spark, S.cell_text, ["a|b", " x \r\n\r\n y  z ", None, "&lt;&nbsp;&amp;amp;"]) == ["a\\|b", "x<br>y z", "", "< &amp;"]
    assert [M.cell_text(x) for x in ("a|b", " x \r\n\r\n y  z ", None)] == ["a\\|b", "x<br>y z", ""]
    assert column(spark, S.style_level, ["Heading2", "10", "0", "Normal", None]) == [2, 6, None, None, None]
    assert column(spark, S.text_level, ["1.2.3 Title", "1. T", "x", None]) == [3, 1, None, None]
    assert column(spark, S.resolve_path, ["media/a.png", "/word/media/a.png", "../media/a", "/media/a", "", None]) == ["word/media/a.png", "word/media/a.png", "media/a", "word/media/a", "", ""]
    assert column(spark, S.sanitize_stem, ["a/b:c", "", "...", "…", None, "“x” y"]) == ["a_b_c", "document", "document", "document", "document", "x y"]
    long = column(spark, S.sanitize_stem, ["a" * 130])[0]
    assert len(long) == 120 and long == "a" * 111 + "_" + S.short_hash("a" * 130)
    assert column(spark, S.format_double, [3.0, 0.1, 1e-7, 123456789.5, None], "double") == ["3", "0.1", "1e-07", "123456789.5", ""]
    images = [b"RIFF0000WEBP", b"BM..", b"\0" * 40 + b" EMF", b"abc", None, b""]
    assert column(spark, S.image_format, images, "binary") == [".webp", ".bmp", ".emf", None, None, None]


def test_grids():
    a, b, c = ("A", 1, 1), ("B", 1, 1), ("C", 1, 1)
    assert M.expand_spans([[("A", 2, 1), b], [c]]) == [["A", "B"], ["A", "C"]]
    assert M.expand_spans([[("A", 1, 2)], [b, c]]) == [["A", "A"], ["B", "C"]]
    assert M.expand_spans([[("A", 3, 1), b]]) == [["A", "B"], ["A", ""], ["A", ""]]
    rng = random.Random(1)
    for _ in range(300):
        rows = [[(str(rng.random()), rng.randint(1, 3), rng.randint(1, 3)) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 5))]
        out = M.expand_spans(rows)
        assert len({len(r) for r in out}) <= 1 and len(out) >= len(rows)
    assert H.table_markdown("<table><tr><td>a</td></tr></table>") == "| a |\n| --- |\n\n" and H.table_markdown("<table></table>") == "" and a


@pytest.mark.parametrize(
    "text,want",
    [
        ("1. **Intro**", "# 1. Intro"),
        ("1.2 **X**", "## 1.2 X"),
        ("## H\n1. **A**\n2. **B**", "## H\n### 1. A\n### 2. B"),
        ("1.2.3.4.5.6.7 **X**", "###### 1.2.3.4.5.6.7 X"),
        ("1.**X**", "1.**X**"),
        ("**T**\n\n# 1. A", "# T\n\n# 1. A"),
        ("**T**\n\n# Intro", "**T**\n\n# Intro"),
        ("**a** and **b**\n## 1 X", "# a** and **b\n## 1 X"),
    ],
)
def test_headings(spark, text, want):
    assert M.promote_title(M.promote_numbered(text)) == want
    lines = headings.md_lines(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t")
    out = headings.promote_title(headings.promote_numbered(lines, "d"), "d").orderBy("line_no").collect()
    assert "\n".join(r["line"] for r in out) == want


def test_html(spark):
    def md(html, **k):
        return column(spark, lambda c: H.html_to_markdown(c, **k), [html])[0]

    assert md("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>") == "- a\n  - b\n- c"
    assert md('<a href="u"><strong>x</strong></a>') == "[**x**](u)" and md("<img alt='t' src='a.png'>") == "![](a.png)"
    assert md("<p>A &lt; B and C &gt; D</p>") == "A  D" and md("<p>A &lt; B and C &gt; D</p>", compat=False) == "A < B and C > D"
    note = '<p>See<sup><a href="#footnote-1" id="footnote-ref-1">[1]</a></sup></p><ol><li id="footnote-1"><p>Body <a href="#footnote-ref-1">↑</a></p></li></ol>'
    assert "See[^1]" in md(note) and md(note).endswith("---\n\n[^1]: Body")
    nested = "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>"
    assert md(nested, compat=False).startswith("| ")
    assert column(spark, H.html_to_markdown, [None, "", "<script>x</script>y"]) == [None, "", "xy"]
    assert md("<script>x</script>y", scripts=False) == "y"


def test_blocks():
    text = "Title\n=====\n\n1. one\n   more\n2. two\n\n> quote\n\n| a | b |\n|---|:-:|\n| **c** | d\\|e |\n\n~~~\ncode *x*\n~~~\n***\n![](p.png)\n\n[t](u) `k`"
    assert B.blocks(text) == [("h1", "Title"), ("bullet", "one\nmore"), ("bullet", "two"), ("paragraph", "quote"), ("code", "| a | b |\n| c | d|e |"), ("code", "code *x*"), ("paragraph", "t k")]
    flat = {"a *b* **c** ***d*** __e__ _f_": "a b c d e f", "x*** y z*** w": "x y z w", "2 * 3 * 4": "2 * 3 * 4", "a_b_c `*k*`": "a_b_c *k*", "**a *b* c** * d": "a b c * d", "*a": "*a", "![p](q)[t](u)": "t"}
    assert {x: B.flat(x) for x in flat} == flat
    assert B.blocks("- a\n    - b\n- c") == [("bullet", "b"), ("bullet", "c")]  # an item loses its text to a list in it
    assert B.blocks("- a\n- b\n\n- c\n- d") == [("bullet", "a"), ("paragraph", "b"), ("paragraph", "c"), ("bullet", "d")]
    assert B.blocks("1. a\n\n    more\n\ntext\n- no list") == [("paragraph", "a"), ("paragraph", "more"), ("paragraph", "text\n- no list")]
    assert B.blocks("- a\n    - b\n\n- c") == [("paragraph", "a"), ("bullet", "b"), ("paragraph", "c")]
    assert B.blocks("    code <x>\n\n| a | b |\n|--|--|\n| c |\n\nx\n## H ##\n- i") == [("code", "code <x>"), ("code", "| a | b |\n| c |  |"), ("paragraph", "x"), ("h2", "H"), ("bullet", "i")]
    assert B.blocks(None) == B.blocks("") == B.blocks("\n \n") == [] and B.blocks("A<B") == [("paragraph", "A<B")]


def test_pdf():
    import re

    from leafmill.sinks.pdf import Chinese, Latin, broken, pdf

    pages, data = pdf("# Tïtle\n\n" + "word " * 3000 + "\n\n```\n(a\\b)\n```\n")
    assert pages > 3 and data == pdf("# Tïtle\n\n" + "word " * 3000 + "\n\n```\n(a\\b)\n```\n")[1]
    assert data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page ") == pages and b"(\\(a\\\\b\\)) Tj" in data and "(Tïtle)".encode("cp1252") in data
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(f"{n} 0 obj".encode())
    for m in re.finditer(rb"/Length (\d+) >>\nstream\n", data):
        assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")
    assert pdf("中文 😀")[1].count(b"/STSong-Light") == 3 and "中文".encode("utf-16-be").hex().encode() in pdf("中文 😀")[1]
    assert pdf(None)[0] == pdf("")[0] == 1
    for font, text in ((Latin, "some words of which a few are " + "long" * 60 + " and more"), (Chinese, "中文" * 80 + " abc " + "文" * 50)):
        lines = broken(text, 20_000, font.width)
        assert all(sum(map(font.width, x)) <= 20_000 for x in lines) and "".join(lines).replace(" ", "") == text.replace(" ", "") and len(lines) > 3


def test_sheets(spark):
    rows = [["", "", " "], ["a", "", "b"], ["c", "", ""]]
    assert xlsx.workbook_markdown(samples.workbook([("s", rows, [])])) == "| a | b |\n| --- | --- |\n| c |  |"
    merged = xlsx.workbook_markdown(samples.workbook([("s", [["H", None], [1, True]], ["A1:B1"])]))
    assert merged == "> merge_ranges: A1:B1\n\n| H | H |\n| --- | --- |\n| 1 | True |"
    assert xlsx.workbook_markdown(samples.workbook([("s", [[" "]], [])])) is None
    cells = spark.createDataFrame([(0, r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)], "s int, r int, c int, v string")
    assert sorted(map(tuple, grid.trim(cells, ["s"]).select("r2", "c2", "v").collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "")]
    assert xlsx.moment_text(45293, False) == "2024-01-02" and xlsx.moment_text(45293.5, False) == "2024-01-02 12:00:00" and xlsx.moment_text(0.25, False) == "06:00:00"


def test_limits_and_bad_workbooks(spark):
    """A workbook beyond the limits, or a broken one, is told and its document converted; a wider limit takes it."""
    big = samples.workbook([("s", [["a" * 2_000_000]], [])])
    books = {"word/embeddings/a.xlsx": b"no archive", "word/embeddings/b.xlsx": big}
    rels = [("rId1", "package", "embeddings/b.xlsx"), ("rId2", "image", "media/p.png")]
    picture = samples.paragraph('<w:r><w:object><v:shape><v:imagedata r:id="rId2"/></v:shape><o:OLEObject r:id="rId1"/></w:object></w:r>')
    df = spark.createDataFrame([("file:/a.docx", samples.document(samples.paragraph(samples.run("x")) + picture, rels, books | {"word/media/p.png": samples.PNG}))], "path string, content binary")
    strict = docx.converted(df).first()
    assert strict["error"] is None and [r["part"] for r in strict["rejects"]] == ["word/embeddings/a.xlsx", "word/embeddings/b.xlsx"] and "![](assets/p.png)" in strict["markdown"]
    wide = docx.converted(df, limits=xlsx.Limits(ratio=10_000)).first()
    assert [r["part"] for r in wide["rejects"]] == ["word/embeddings/a.xlsx"] and "a" * 2_000_000 in wide["markdown"]


def test_bad_packages(spark):
    bomb = samples.document("", [], {"word/media/z.png": b"\0" * (3 << 20)})
    entity = samples.packed({"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'})
    good = samples.document(samples.paragraph(samples.run("x < y & z")), [])
    rows = [("file:/a.docx", b""), ("file:/b.docx", b"PK"), ("file:/c.docx", bomb), ("file:/d.docx", entity), ("file:/e%20f.docx", good), ("file:/g.docx", samples.packed({"word/document.xml": "<a"}))]
    got = {r["path"][6]: r for r in docx.converted(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[k]["error"] and got[k]["markdown"] is None for k in "abcdg") and got["e"]["markdown"] == "x < y & z" and got["e"]["stem"] == "e f"
    assert {r["path"][6] for r in docx.parts(spark.createDataFrame(rows, "path string, content binary")).where("error is not null").collect()} == set("abc")


def test_queue_of_tables():
    """Two workbooks with one preview: its occurrences take their tables in turn, and the last one again."""
    picture = '<w:r><w:object><v:shape><v:imagedata r:id="{}"/></v:shape>{}</w:object></w:r>'
    body = "".join(samples.paragraph(picture.format(i, f'<o:OLEObject r:id="{b}"/>' if b else "")) for i, b in (("rId2", "rId1"), ("rId4", "rId3"), ("rId2", ""), ("rId4", "")))
    rels = [("rId1", "package", "embeddings/a.xlsx"), ("rId2", "image", "media/p.png"), ("rId3", "package", "embeddings/b.xlsx"), ("rId4", "image", "media/q.png")]
    parts = {f"word/embeddings/{n}.xlsx": samples.workbook([("s", [[n], ["v"]], [])]) for n in "ab"} | {"word/media/p.png": b"same", "word/media/q.png": b"same"}
    _, md, assets, _ = docx.convert("x.docx", samples.document(body, rels, parts))
    assert [x[2] for x in md.split("\n") if x in ("| a |", "| b |")] == ["a", "b", "b", "b"] and assets == []


def test_batches_and_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(name, text):
        (source / name).write_bytes(samples.document(samples.paragraph(samples.run(text)), []))

    put("a.docx", "one")
    put("b.DOCX", "two")
    put("c.doc", "no")
    (source / "bad.docx").write_bytes(b"bad")
    status = lambda *a: {r["status"]: r["n"] for r in convert.run(spark, str(source), str(tmp_path / "out"), *a).collect()}
    marks = (str(source), str(tmp_path / "stream"), str(tmp_path / "marks"))
    assert status() == {"ok": 2, "failed": 1}
    incremental.convert_new(spark, *marks)
    put("d.docx", "three")
    assert status() == {"ok": 1, "skipped": 2, "failed": 1}
    incremental.convert_new(spark, *marks)
    incremental.convert_new(spark, *marks)
    assert {r["markdown"] for r in spark.read.parquet(f"{marks[1]}/*/documents").collect()} == {"one", "two", "three"}
    assert spark.read.parquet(f"{marks[1]}/*/documents").count() == 3
    put("a.docx", "new")
    assert status(True) == {"ok": 3, "failed": 1}
    assert {r["markdown"] for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect()} == {"new", "two", "three"}
    files = write_folders(docx.converted(docx.scan(spark, str(source))), str(tmp_path / "md")).collect()
    assert sorted(os.path.relpath(r["file"], tmp_path) for r in files) == ["md/a/a.md", "md/b/b.md", "md/d/d.md"]
    (tmp_path / "none").mkdir()
    assert convert.run(spark, str(tmp_path / "none"), str(tmp_path / "nothing")).count() == 0 and not (tmp_path / "nothing").exists()


def test_entities_without_a_semicolon(spark):
    """HTML5 decodes some of them; with ``closed`` they stay, wherever in the text they stand and even where dropped tags or decoding make one."""
    texts = ["a &amp</title><b> &am", "&copy &copy; &amp;copy &#65 &#65;", "&am</i>p;", "&notit; &lt;x &ampamp;"]
    assert column(spark, S.unescape, texts) == ["a &</title><b> &am", "© © &copy A A", "&am</i>p;", "¬it; <x &amp;"]
    assert column(spark, lambda c: S.unescape(c, closed=True), texts) == ["a &amp</title><b> &am", "&copy © &copy &#65 A", "&am</i>p;", "&notit; <x &ampamp;"]
    pages = ["<p>x&&amp</p>", "<title>y&am</title><style>p{}</style>&copy &amp;copy &amp;&amp; &copy;", "&amp", "<table><tr><td>&amp &amp;</td></tr></table>", None]
    closed = column(spark, lambda c: H.html_to_markdown(c, closed=True), pages)
    assert closed == ["x&&amp", "y&amp{}&copy &copy && ©", "&amp", "| &amp & |\n| --- |", None]
    assert column(spark, H.html_to_markdown, pages) == ["x&&", "y&{}© © && ©", "&", "| & & |\n| --- |", None]


def test_rows_share_batches(spark):
    """What is made of small rows travels together; a batch that is full goes at once, and no row is lost or out of order."""
    from leafmill.sources import batches

    def make(n, text):
        return [(n, k, text, [{"a": text, "b": b"x"}]) for k in range(n % 3)]

    frame = spark.createDataFrame([(n, "y" * (batches.BATCH_BYTES if n == 50 else 1)) for n in range(100)], "n int, text string").coalesce(1)
    found = batches.made(frame, ["n", "text"], make, [("n", "int"), ("k", "int"), ("t", "string"), ("l", "array<struct<a: string, b: binary>>")])
    sizes = found.select("n", "k").mapInArrow(lambda bs: (b for b in bs), "n int, k int").collect()
    assert [tuple(r) for r in sizes] == [(n, k) for n in range(100) for k in range(n % 3)]
    assert found.where("n = 50").selectExpr("length(t)", "length(l[0].a)").first()[:] == (batches.BATCH_BYTES, batches.BATCH_BYTES)


def test_few_listings(spark):
    from leafmill.tables import few_listings

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with few_listings(spark):
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism < int(before)
    assert spark.conf.get(key) == before


def test_a_stream_lists_its_batches_by_few_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(samples.document(samples.paragraph(samples.run("one")), []))
    key, seen = "spark.sql.sources.parallelPartitionDiscovery.parallelism", []
    before = spark.conf.get(key)
    monkeypatch.setattr(incremental, "write_tables", lambda *a: seen.append(spark.conf.get(key)))
    incremental.convert_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(key) == before


def test_contents_are_not_shuffled_to_skip_what_is_done(spark, tmp_path):
    from leafmill.operators import batch

    found = spark.createDataFrame([("a", b"x"), ("b", b"y"), (None, b"z")], "path string, content binary")
    done = spark.createDataFrame([("b",), (None,)], "path string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        planned = batch.plan(found, done, "path", wide=True)
        plan = planned._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(str, planned.select("content", "status").collect())) == sorted(map(str, batch.plan(found, done, "path").select("content", "status").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
