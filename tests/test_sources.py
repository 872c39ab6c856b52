import io
import json
import zipfile

from pyspark.sql import functions as F

from docmill.sources import files, html, office

PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body>lost text
<h2>Head <b>line</b></h2><p>One&amp;two</p><p>One&amp;two</p><div><ul><li>item</li></ul><span>lost</span></div>
<table><tr><td>a|b</td><td>2</td></tr><tr><th>H</th><th>V</th></tr></table><br><blockquote>said <a href="/x">here</a></blockquote></body></html>"""
SPANS = '<table><tr><th rowspan="2">A</th><th colspan="2">B</th></tr><tr><td>1</td><td>2</td></tr><tr><td></td></tr></table>'


def test_html_blocks():
    assert html.html_blocks(PAGE) == [
        ("heading", "## Head line", 2), ("text", "One&two", None), ("list_item", "- item", None),
        ("table", "| H | V |\n| --- | --- |\n| a\\|b | 2 |", None), ("text", "said here", None),
    ]


def test_unclosed_paragraph_holds_what_follows():
    assert html.html_blocks("<p>one<p>two<li>three") == [("text", "one two three", None)]


def test_spans():
    grid, merged = html.table_grid(html.parse(SPANS))
    assert grid == [["A", "B", "B"], ["A", "1", "2"]] and merged == [(0, 2, "B", "colspan"), (1, 0, "A", "rowspan")]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "text\n" + SPANS)], "doc_id bigint, html string")
    assert [r["type"] for r in html.read_html_blocks(df.where("doc_id < 4")).orderBy("block_idx").collect()] == ["heading", "text", "list_item", "table", "text"]
    assert [(r["text"], r["href"]) for r in html.html_links(df).collect()] == [("here", "/x")]
    cells = html.html_tables(df.where("doc_id = 4"), "doc_id", "html").collect()
    assert {(r["start_line"], r["row_index"], r["column_index"], r["value"]) for r in cells} >= {(2, 0, 2, "B"), (2, 1, 0, "A")}


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    return packed({
        "word/document.xml": f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>"
        f"<w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('1')}</w:tr></w:tbl></w:body></w:document>"
    })


def pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
    table = f"<a:tbl><a:tr><a:tc>{p('k')}</a:tc><a:tc>{p('v')}</a:tc></a:tr></a:tbl>"
    return packed({"ppt/slides/slide10.xml": f"<s {a}>{p('last')}</s>", "ppt/slides/slide2.xml": f"<s {a}>{p('first')}{table}</s>"})


def test_office_blocks(spark):
    rows = [("/a/x.docx", docx()), ("/a/y.pptx", pptx()), ("/a/bad.docx", b"no zip"), ("/a/z.pdf", b"%PDF")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = [tuple(r) for r in office.read_office_blocks(df).orderBy("path", "block_idx").select("path", "type", "text", "page_idx").collect()]
    assert got == [
        ("/a/bad.docx", None, None, None),
        ("/a/x.docx", "heading", "## Title", None), ("/a/x.docx", "text", "Some text", None), ("/a/x.docx", "table", "| k | v |\n| --- | --- |\n| a | 1 |", None),
        ("/a/y.pptx", "heading", "# Slide 1", 0), ("/a/y.pptx", "text", "first", 0), ("/a/y.pptx", "table", "| k | v |\n| --- | --- |", 0),
        ("/a/y.pptx", "heading", "# Slide 2", 1), ("/a/y.pptx", "text", "last", 1),
    ]


def test_content_lists(spark):
    flat = json.dumps([{"type": "text", "text": "a", "page_idx": 3}, 5, {"type": "table", "content": {"table_caption": [{"content": "cap"}, "two"]}}])
    nested = json.dumps([[{"text": "p0"}], [{"text": "", "content": "p1"}, None]])
    df = spark.createDataFrame([(1, flat), (2, nested), (3, "{}"), (4, None), (5, "[")], "doc_id int, content_list string")
    got = files.read_content_list(df).select("doc_id", "page_idx", "block_idx", files.block_text(F.col("block")).alias("text"), "error")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [
        (1, 3, 0, "a", None), (1, None, 1, "", "unsupported content item"), (1, None, 2, "cap\ntwo", None),
        (2, 0, 0, "p0", None), (2, 1, 0, "p1", None), (2, 1, 1, "", "non-dict block in page"),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("caf\xe9".encode("latin-1"))
    assert files.read_markdown(spark, str(tmp_path)).first()["text"] == "caf�"
    df = spark.createDataFrame([("/a.HTML", 5), ("/b.exe", 5), ("/c.pdf", 0), ("/d.pdf", 10**9)], "path string, length bigint")
    assert [(r["native"], r["reject"]) for r in files.admitted(df).orderBy("path").collect()] == [(True, None), (False, "unsupported suffix"), (False, "empty file"), (False, "too large")]
    pdf = spark.createDataFrame([(bytearray(b"/Type /Page /Type/Page /Type /Pages"),)], "content binary")
    assert pdf.select(files.pdf_page_count(F.col("content"))).first()[0] == 2
    manifest = spark.createDataFrame([({"task": "t0"}, [{"id": "1", "profile": "p"}, {"id": "2", "task": "t2"}])], "defaults map<string,string>, tasks array<map<string,string>>")
    assert [tuple(r)[1:] for r in files.batch_tasks(manifest, {"profile": "c"}).orderBy("task_no").collect()] == [("1", None, "t0", "p"), ("2", None, "t2", "c")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "é"), ("q", 2, None)], "profile string, id int, text string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        files.append_outcomes(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("profile = 'p'").count() == 2
