import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docmill.operators import blocks, facts, keyvalues, quality, search, setops
from docmill.plans import reports
from docmill.queries import REGISTRY

SF = "/root/testdata/sf0.001"
CHECKED = [n for n, q in REGISTRY.queries.items() if n in REGISTRY.sql and q.__module__.endswith(("coverage", "problems"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_their_statements(spark, duck, name):
    got, want = REGISTRY.queries[name](spark, SF), duck.execute(REGISTRY.sql[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rounded = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(rounded, got.select(columns).collect()))) == sorted(map(repr, map(rounded, want.fetchall())))


def test_set_operations(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 2)], "k string, v int")
    groups = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "k string, v string")
    assert sorted(map(repr, map(tuple, setops.uncovered(cases, groups, "k").collect()))) == ["('b', 2)", "('b', 2)", "(None, 3)"]
    rows = spark.createDataFrame([("g", ["a", "b", None], True), ("g", ["a", "c"], False), ("g", None, None), ("h", ["a"], None)], "by string, codes array<string>, ok boolean")
    assert {tuple(r) for r in setops.unhandled_codes(rows, "by", "codes", F.col("ok")).collect()} == {("g", "c"), ("h", "a")}
    one = spark.createDataFrame([(["x", "y"], ["x", " z ", "", None, "z"]), (None, ["q"]), (["x"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in one.select(setops.merged_steps(F.col("a"), F.col("b"), "+")).collect()] == [["x", "y", "+z", "+z"], ["+q"], ["x"]]
    acts = spark.createDataFrame([(1, "retry", 2, "b"), (1, "retry", 1, "a"), (1, None, 3, "c"), (1, "", 4, "d"), (2, "retry", 1, "e")], "case int, name string, at int, src string")
    assert {(r["case"], r["source"], tuple(r["further_sources"])) for r in setops.deduped_actions(acts, ["case"], "name", "at", "src").collect()} == {(1, "a", ("b",)), (2, "e", ())}


def test_chunk_errors(spark):
    good = {"chunk_id": "a", "page_no": 1, "pages": [1], "content_type": "text", "section_title": "s", "chunk_text": "t", "image_path": ""}
    rows = [good, good | {"pages": 3}, good | {"page_no": "1"}, good | {"page_no": 1.5}, good | {"chunk_text": None}, {k: v for k, v in good.items() if k != "pages"}, [good]]
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(rows)] + [(9, "{", ""), (10, None, "")], "id int, chunk string, error string")
    got = sorted(map(tuple, reports.chunk_errors(df, "id", "chunk").collect()))
    assert got == [(1, "pages_not_list"), (2, "page_no_not_int"), (3, "page_no_not_int"), (4, "chunk_text_not_string"), (5, "missing:pages"), (6, "chunk is not an object"), (9, "chunk is not an object"), (10, "chunk is not an object")]


def test_short_texts_of_native_documents(spark):
    rows = [(1, "x" * 79, True, False), (2, "x" * 80, True, False), (3, "x", True, True), (4, "x" * 100, False, True), (5, " ", True, True), (6, "x" * 90, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, native boolean, general boolean")
    got = {(r["doc_id"], r["code"]) for r in quality.issues(df, *quality.text_rules(F.col("text"), F.col("native"), F.col("general"))).collect()}
    assert got == {(1, "short_text"), (4, "short_text"), (5, "empty_markdown"), (6, "short_text")}


def test_page_rules(spark):
    df = spark.createDataFrame([(1, 0, 0, False), (2, 5, 0, True), (3, 5, 0, False), (4, 31, 1, False), (5, 30, 1, False), (6, 99, 2, True)], "doc_id int, items int, pages int, native boolean")
    got = {tuple(r) for r in quality.issues(df, *quality.page_rules(F.col("items"), F.col("pages"), F.col("native"))).collect()}
    assert got == {(1, "no_content_blocks", "warning"), (2, "document_level_provenance", "info"), (3, "no_page_provenance", "warning"), (4, "weak_page_provenance", "warning")}


def test_told_tables_and_figures(spark):
    html = "<table><TR class='h'><th>a</th><td> b <b>c</b></td></TR>\n<tr><td></td></tr><tr><td>1</td><td>2</td></tr></table>"
    rows = [(1, html, ["T", None, "U"], ["n"]), (2, "plain", [], None), (3, "", ["T"], None), (4, "", None, None)]
    df = spark.createDataFrame(rows, "id int, html string, caption array<string>, note array<string>")
    got = [r[0] for r in df.orderBy("id").select(blocks.table_told(F.col("html"), F.col("caption"), F.col("note"))).collect()]
    assert got == ["Table: T U\nColumns: a | b c\nRow 1: 1 | 2\nNote: n", "plain", "Table: T", ""]
    rows = [(1, "own", ["c"], "p"), (2, "", ["c", None], "p"), (3, "", None, "p"), (4, "", [], None)]
    df = spark.createDataFrame(rows, "id int, text string, caption array<string>, img string")
    assert [r[0] for r in df.orderBy("id").select(blocks.figure_told(F.col("text"), F.col("caption"), F.col("img"))).collect()] == ["own", "c", "Figure image", ""]


def test_chunks_come_from_blocks_or_else_from_the_text(spark):
    held = spark.createDataFrame([("a", 1, "text", "of a block", 0)], "doc_id string, block_ord int, type string, text string, page_idx int")
    docs = spark.createDataFrame([("a", "of a text"), ("b", "of b"), ("c", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["chunk_text"]) for r in blocks.chunks_of(held, docs).collect()} == {("a", "of a block"), ("b", "of b")}


def test_section_pages(spark):
    docs = spark.createDataFrame([("a", "# Scope\nfirst words here\n# Other\n"), ("b", "no heading")], "doc_id string, text string")
    rows = [("a", 1, "nothing", 0), ("a", 2, "the Scope of it", None), ("a", 3, "first words here and more", 4), ("a", 4, "Scope", 2), ("b", 1, "has no heading", 7)]
    got = blocks.section_pages(docs, spark.createDataFrame(rows, "doc_id string, block_ord int, text string, page_idx int")).collect()
    assert {tuple(r) for r in got} == {("a", 1, 5), ("a", 2, None), ("b", 1, 8)}


def test_matched_runs(spark):
    rows = spark.createDataFrame([(1, "r", "f"), (2, "x", "f"), (3, None, None), (4, "x", "y")], "id int, run string, file string")
    runs = spark.createDataFrame([("r", "g", 7), ("r", "g", 5), ("q", "f", 9), (None, None, 1)], "run string, file string, no int")
    assert {tuple(r) for r in reports.matched_runs(rows, runs, "id", "run", "file", "no").collect()} == {(1, 5, "run"), (2, 9, "file"), (3, None, None), (4, None, None)}


def test_check_summary(spark):
    rows = [("a", True, True), ("a", True, False), ("b", False, True)]
    got = {tuple(r) for r in reports.check_summary(spark.createDataFrame(rows, "kind string, expected boolean, passed boolean")).collect()}
    assert got == {("a", 2, 1, 1, 0.5), ("b", 0, 0, 0, 1.0), ("*", 2, 1, 1, 0.5)}


def test_field_coverage_and_entities(spark):
    df = spark.createDataFrame([(1, "Datum 2024-01-02, 建议复核"), (2, None), (3, "甲方：X\nNote: y\nIssuing COMPANY: Z")], "doc_id int, text string")
    assert {tuple(r) for r in facts.field_coverage(df).collect()} == {(1, True, True, True), (2, False, False, False), (3, False, False, False)}
    assert [r["value"] for r in keyvalues.entity_candidates(keyvalues.key_values(df)).orderBy("kv_index").collect()] == ["X", "Z"]


def test_one_scope_and_few_queries_are_split_over_tasks(spark):
    chunks = spark.createDataFrame([("s", i, f"word{i} common") for i in range(300)], "scope string, chunk_ord int, text string")
    asked = spark.createDataFrame([(1, "s", "word7 common"), (2, "t", "x"), (3, "s", None)], "query_id int, scope string, query string")
    got = search.lexical_top_k(asked, chunks).where("rank = 1").collect()
    assert {(r["query_id"], r["chunk_ord"], r["holds_query"]) for r in got} == {(1, 7, True), (3, 0, True)}
    rates = {tuple(r) for r in search.hit_rates(search.lexical_top_k(asked, chunks), asked, "scope").collect()}
    assert rates == {("s", 2, 2, 1.0), ("t", 1, 0, 0.0)}
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id int, vector array<double>")
    near = lambda **settings: sorted(map(tuple, search.nearest_vectors(vectors.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), vectors, **settings).collect()))
    assert near(blocks=1, parts=1) == near(blocks=3, parts=5) == near()
