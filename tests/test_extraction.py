import pytest

from docmill.operators import blocks, documents, facts, keyvalues, quality, tables

SHEET = """intro line
# First Part
公司名称：示例公司
- Status: open
Owner:

Alice
# Table
| 项目 | 2026 | 2025 |
| --- | --- | --- |
| 收入 | 100 | 90 |
| 成本 | 50 |  |
| 合计 | 150 | 95 |
tail 12 items on 2026-05-03 风险提示, 参见第 3 页
## Empty
"""


def frame(spark, *texts, extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return df.selectExpr("*", "'clash' as line", "1 as line_no", "array('x') as lines", "'k' as key") if extra else df


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lines(spark):
    got = rows(documents.lines(frame(spark, "a\r\nb\n\nc\n", "", None, "x")), "doc_id", "line_no", "line")
    assert got == [(0, 1, "a"), (0, 2, "b"), (0, 3, ""), (0, 4, "c"), (3, 1, "x")]


def test_sections(spark):
    got = rows(documents.sections(frame(spark, SHEET, "plain text", "  ", None)), "doc_id", "section_no", "level", "title", "line", "source")
    assert got == [(0, 1, 1, "First Part", 2, "heading"), (0, 2, 1, "Table", 8, "heading"), (0, 3, 2, "Empty", 15, "heading"), (1, 1, 1, "document", None, "fallback")]
    bodies = {r["section_no"]: r["text"] for r in documents.sections(frame(spark, SHEET)).collect()}
    assert bodies[3] == "" and bodies[1].startswith("公司名称") and bodies[1].endswith("Alice")


def test_tables(spark):
    (table,) = tables.tables(frame(spark, SHEET, "| one |", None)).collect()
    assert (table["headers"], table["row_count"], table["column_count"], table["start_line"]) == (["项目", "2026", "2025"], 3, 3, 9)
    assert table["body"][1] == ["成本", "50", "90"]
    assert rows(tables.merged_cells(tables.tables(frame(spark, SHEET))), "row_index", "column_index", "value") == [(2, 2, "90")]


def test_two_header_levels_and_ragged_rows(spark):
    text = "| A | B |\n| x | y |\n| 1 | 2 |\n| 3 |\n\n| --- |\n| --- |"
    first, second = sorted(tables.tables(frame(spark, text)).collect(), key=lambda r: r["table_index"])
    assert (first["headers"], first["body"], first["header_levels"]) == (["A / x", "B / y"], [["1", "2"], ["3", "2"]], 2)
    assert (second["headers"], second["row_count"], second["column_count"]) == ([], 0, 0)


def test_totals(spark):
    got = rows(tables.total_checks(tables.tables(frame(spark, SHEET))), "column_index", "expected", "computed", "outcome")
    assert got == [(1, 150.0, 150.0, "verified"), (2, 95.0, 180.0, "mismatch")]
    short = "| a | b |\n| x | 1 |\n| total | 1 |"
    assert rows(tables.total_issues(tables.total_checks(tables.tables(frame(spark, short)))), "code", "level") == [("numeric_total_needs_review", "warning")]


def test_key_values(spark):
    got = [tuple(r) for r in keyvalues.key_values(frame(spark, SHEET, None, "")).orderBy("kv_index").select("key", "value").collect()]
    assert ("公司名称", "示例公司") in got and ("Status", "open") in got and ("Owner", "Alice") in got
    assert len(got) == len(set(got))


@pytest.mark.parametrize("line", ["12: x", "http://a: b", ": x", "no delimiter", "x" * 61 + ": y"])
def test_lines_that_are_no_key_values(spark, line):
    found = {r["key"] for r in keyvalues.line_pairs(frame(spark, line)).collect()}
    assert found <= {"http"}  # an address parts at its first colon


def test_evidence(spark):
    docs = frame(spark, SHEET)
    kv = keyvalues.key_values(docs)
    plain = {r["key"]: r for r in keyvalues.field_evidence(kv, docs).collect()}
    assert (plain["Status"]["line_no"], plain["Status"]["confidence"], plain["Status"]["level"]) == (4, 0.72, "markdown_line")
    found = spark.createDataFrame([(0, 1, "other", 0, "pdf"), (0, 2, "Status here", 1, "pdf"), (0, 3, "Status: open", 4, "pdf"), (0, 4, "Alice", None, "html")], "doc_id bigint, block_ord int, text string, page_idx int, source string")
    paged = {r["key"]: r for r in keyvalues.field_evidence(kv, docs, found).collect()}
    assert (paged["Status"]["block_idx"], paged["Status"]["page_no"], paged["Status"]["confidence"], paged["Status"]["level"]) == (3, 5, 0.95, "page")
    assert (paged["Owner"]["block_idx"], paged["Owner"]["confidence"], paged["Owner"]["level"]) == (4, 0.86, "document")


def test_facts_dates_signals_references(spark):
    docs = frame(spark, SHEET, "2026-01-02 and 2026-01-02, 3/4/2025", None)
    assert (0, 14, ["12", "3"]) in [tuple(r) for r in facts.numeric_facts(docs).select("doc_id", "line_no", "numbers").collect()]
    assert rows(facts.dates(docs), "doc_id", "date_no", "date") == [(0, 1, "2026-05-03"), (1, 1, "2026-01-02"), (1, 2, "3/4/2025")]
    assert rows(facts.signal_lines(docs), "doc_id", "line_no") == [(0, 14)]
    (ref,) = facts.references(docs).collect()
    assert (ref["reference_text"], ref["target_page"], ref["relation"], ref["confidence"], ref["source_title"]) == ("参见第 3 页", 3, "page_reference", 0.78, "Table")


def test_caps_keep_the_first(spark):
    docs = frame(spark, "\n".join(f"n {i}" for i in range(700)))
    got = facts.numeric_facts(docs).collect()
    assert len(got) == facts.MOST_FACTS and max(r["line_no"] for r in got) == facts.MOST_FACTS
    assert len(facts.numeric_facts(docs, most=None).collect()) == 700


def test_quality(spark):
    docs = frame(spark, "", "Ã©" * 10 + "x" * 300, "x" * 300, "short", "Ã©" + "x" * 300, extra=False).na.fill("")
    got = {r["doc_id"]: (r["score"], r["status"]) for r in quality.graded_inline(docs, *quality.text_rules(docs["text"])).collect()}
    assert got == {0: (70, "needs_review"), 1: (70, "needs_review"), 2: (100, "pass"), 3: (92, "pass_with_warnings"), 4: (92, "pass_with_warnings")}
    by_rows = {r["doc_id"]: r["score"] for r in quality.score(quality.issues(docs, *quality.text_rules(docs["text"])), docs).collect()}
    assert by_rows == {k: v[0] for k, v in got.items()}


def test_best_attempt_keeps_the_earlier_of_equals(spark):
    tries = [(1, 0, "initial", "pass", 100, 0, 0), (1, 1, "cleanup", "pass", 100, 0, 0), (2, 0, "initial", "needs_review", 40, 2, 0), (2, 1, "cleanup", "pass_with_warnings", 92, 0, 1)]
    df = spark.createDataFrame(tries, "doc_id int, attempt_no int, name string, status string, score int, errors int, warnings int")
    assert rows(quality.best_attempt(df), "doc_id", "name") == [(1, "initial"), (2, "cleanup")]


def split_by_hand(text, most):
    import re

    cost = lambda x: max(1, len(x) // 4)
    if cost(text) <= most:
        return [text] if text.strip() else []
    done, held, n = [], [], 0
    for paragraph in re.split(r"\n{2,}", text):
        for unit in re.split(r"(?<=[.!?。！？])\s+", paragraph) if cost(paragraph) > most else [paragraph]:
            if held and n + cost(unit) > most:
                done, held, n = [*done, "\n\n".join(held)], [], 0
            held, n = [*held, unit], n + cost(unit)
    return [x for x in [*done, "\n\n".join(held)] if x.strip()]


def test_long_texts_are_split_between_sentences(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "end. ", "\n\n", "long" * 9 + "! "]) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r["i"]: r["p"] for r in df.select("i", blocks.split_long_text(df["x"], 40).alias("p")).collect()}
    assert got == {i: split_by_hand(t, 40) for i, t in enumerate(texts)}


def test_chunks_from_blocks(spark):
    data = [
        (1, 1, "header", "noise", 0), (1, 2, "title", "Contents", 0), (1, 3, "text", "skipped", 0), (1, 4, "heading", "Part A", 0),
        (1, 5, "text", "one", 0), (1, 6, "page_number", "3", 0), (1, 7, "text", "two", 0), (1, 8, "text", "next page", 1),
        (1, 9, "table", "| a |", 1), (1, 10, "image", "", 1), (1, 11, "text", "x" * 2600, 1), (1, 12, "text", "after", 1), (1, 13, "odd", "?", 1),
    ]
    df = spark.createDataFrame(data, "doc_id int, block_ord int, type string, text string, page_idx int")
    got = [(r["chunk_id"], r["section_title"], r["chunk_text"][:12]) for r in blocks.block_chunks(df).orderBy("seq").collect()]
    assert got == [
        ("1:p1:text:1", "Part A", "one\ntwo"), ("1:p2:text:2", "Part A", "next page"), ("1:p2:table:3", "Part A", "| a |"),
        ("1:p2:text:4", "Part A", "x" * 12), ("1:p2:text:5", "Part A", "after"),
    ]
    reasons = rows(blocks.classified_blocks(df).where("reason is not null"), "block_ord", "reason")
    assert reasons == [(1, "noise"), (2, "low_value_section"), (3, "inside_low_value_section"), (4, "heading"), (6, "noise"), (10, "weak_figure"), (13, "unsupported")]


def test_chunks_from_text_and_blocks_of_text(spark):
    docs = frame(spark, SHEET, None)
    got = [(r["content_type"], r["section_title"]) for r in blocks.text_chunks(docs).orderBy("seq").collect()]
    assert got == [("text", "First Part"), ("text", "Table"), ("table", "document")]
    kinds = [r["type"] for r in blocks.text_blocks(docs).orderBy("block_idx").collect()]
    assert kinds == ["text", "heading", "text", "list", "text", "text", "heading", "table", "text", "heading"]


def test_content_summary(spark):
    df = spark.createDataFrame([(1, "text", "ab", 0), (1, "table", None, 2), (1, None, "c", 2), (2, "text", "x", None)], "doc_id int, type string, text string, page_idx int")
    assert rows(blocks.content_summary(df), "doc_id", "item_count", "page_count", "text_characters", "type_counts", "provenance_level") == [
        (1, 3, 2, 3, "table=1,text=1,unknown=1", "page"), (2, 1, 0, 1, "text=1", "document"),
    ]


def test_empty_tables(spark):
    none = frame(spark, "x").limit(0)
    for found in (documents.lines(none), documents.sections(none), tables.tables(none), keyvalues.key_values(none), facts.numeric_facts(none), facts.dates(none), blocks.text_chunks(none), blocks.text_blocks(none)):
        assert found.collect() == []


def test_recovered_texts(spark):
    docs = frame(spark, "cafe\u0301 aaaaaa", None, "plain")
    got = {r["doc_id"]: r["text"] for r in documents.recovered_texts(docs).collect()}
    assert got == {0: "caf\u00e9 aa", 1: "", 2: "plain"}
