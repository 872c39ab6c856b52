import json

import pytest

from docmill.operators import nested

STEP = {"name": "view", "detail": {"source_counts": {"html": 3, "ocr.retry": "4", "x": "n/a", "y": None, "z": 2.5}, "semantic_signal_counts": {"dates": 7.0, "a": "1.2e1"}}}
TRIED = {"name": "decide", "detail": {"attempts": [{"name": "a"}, None, {"detail": {"source_counts": {"pdf": "0"}}}]}}


def rows(spark, payloads, wrap=False):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "trace_id bigint, payload string, body string")
    return {tuple(r) for r in nested.trace_counters(df).collect()}


PLAIN = {("steps/0", "source_counts.html", 3), ("steps/0", "source_counts.ocr.retry", 4), ("steps/0", "semantic_signal_counts.dates", 7), ("steps/0", "semantic_signal_counts.a", 12)}


@pytest.mark.parametrize(
    "payload",
    [
        json.dumps({"steps": [STEP]}),
        json.dumps({"steps": STEP}),
        "\ufeff\n" + json.dumps({"steps": [STEP]}) + "\n",
        json.dumps(json.dumps({"trace": {"steps": [STEP]}})),
        json.dumps({"trace": {"steps": [STEP]}, "schema_version": "1"}, indent=2),
        json.dumps({"steps": [{"detail": json.dumps(STEP["detail"])}]}),
    ],
)
def test_shapes_of_one_record_give_the_same_rows(spark, payload):
    assert rows(spark, [payload]) == {(0, *x) for x in PLAIN}


LISTED = {"source_counts": [{"name": "html", "count": 3}, None, {"name": "ocr.retry", "count": "4"}, {"name": "html", "count": 3}, {"count": 9}, 7], "semantic_signal_counts": {"dates": 7, "a": 12}}


@pytest.mark.parametrize(
    "payload, place",
    [
        (json.dumps({"steps": [{"detail": LISTED}]}), "steps/0"),
        (json.dumps({"steps": [{"detail": {"attempts": [{"detail": LISTED}]}}]}), "steps/0/attempts/0"),
        (json.dumps({"trace": {"steps": [{"detail": LISTED}]}}), "steps/0"),
        (json.dumps({"steps": [{"detail": json.dumps(LISTED)}]}), "steps/0"),
        (json.dumps({"steps": [{"detail": LISTED | {"source_counts": json.dumps(LISTED["source_counts"])}}]}), "steps/0"),
    ],
)
def test_counts_kept_as_a_list_have_their_holders_place(spark, payload, place):
    df = spark.createDataFrame([(0, payload)], "trace_id bigint, payload string")
    assert sorted(tuple(r) for r in nested.trace_counters(df).collect()) == sorted((0, place, *x[1:]) for x in PLAIN)


@pytest.mark.parametrize(
    "text, n",
    [
        ("12", 12), ("+12", 12), ("-12.000", -12), ("1.2e1", 12), ("120E-1", 12), ("0e5", 0), ("0.00e-3", 0), ("-0.5e1", -5), (".5e1", 5), ("0.05e2", 5), ("1.0e3", 1000),
        ("9223372036854775807", 2**63 - 1), ("-9223372036854775808", -(2**63)), ("9223372036854775808", None), ("1e30", None), ("1e999999999", None),
        ("123456789012345678901234567890", None), ("1.00000000000001", None), ("1.000000000000000000000000001", None), ("12.5", None), ("1.25e1", None), ("125e-1", None),
        ("", None), (".", None), ("e5", None), (".e5", None), ("n/a", None), ("1 2", None), ("12\n", 12), ("1\n2", None), ("true", None), (" 7 ", 7), ("1.", 1), (None, None),
    ],
)
def test_whole_numbers_however_written(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(nested.whole_number(df["t"])).first()[0] == n


def test_numbers_in_json(spark):
    payload = '{"steps": [{"detail": {"source_counts": {"a": 1.00000000000001, "b": 12.0, "c": 1.2e1, "d": 123456789012345678901234567890, "e": -3, "f": true, "g": {"x": 1}, "h": [1], "i": 1e2}}}]}'
    df = spark.createDataFrame([(0, payload)], "trace_id bigint, payload string")
    assert {(r["field"][-1], r["n"]) for r in nested.trace_counters(df).collect()} == {("b", 12), ("c", 12), ("e", -3), ("i", 100)}


def test_places_count_null_items_and_attempts(spark):
    got = rows(spark, [json.dumps({"steps": [None, STEP, TRIED]})])
    assert (0, "steps/2/attempts/2", "source_counts.pdf", 0) in got
    assert {x[1] for x in got} == {"steps/1", "steps/2/attempts/2"}


def test_unreadable_payloads_give_no_row(spark):
    whole = json.dumps({"steps": [STEP]})
    bad = [None, "", "   ", "[]", "null", "12", '"text"', whole[:-1], whole[: len(whole) // 2], "{" + whole, whole + "x", whole + whole, whole + ' {"', whole + ",0", whole + "]x", whole[:-1] + "}]}", json.dumps({"steps": None})]
    assert rows(spark, bad) == set()


def test_repeated_records_and_an_empty_table(spark):
    whole = json.dumps({"steps": [STEP]})
    assert len(rows(spark, [whole, whole])) == 2 * len(PLAIN)
    assert nested.trace_counters(spark.createDataFrame([], "trace_id bigint, payload string")).collect() == []


def test_report_scores(spark):
    pairs = [{"baseline": {"quality_score": "84"}, "llm": None}, None, {"baseline": json.dumps({"quality_score": 9.0}), "llm": {"quality_score": "n/a"}}]
    df = spark.createDataFrame([(1, json.dumps({"llm_impact_report": {"pairs": pairs}}))], "report_id bigint, payload string")
    assert {tuple(r) for r in nested.report_scores(df).collect()} == {(1, "pairs/0", "baseline.quality_score", 84), (1, "pairs/2", "baseline.quality_score", 9)}


def test_steps_and_calls(spark):
    payload = json.dumps({"steps": [None, {"name": "a", "status": "done", "detail": {"attempts": [{}, {}]}}], "tool_calls": {"tool": "t", "elapsed_seconds": 1.5}})
    df = spark.createDataFrame([(1, payload)], "trace_id bigint, payload string")
    assert [tuple(r)[:4] for r in nested.trace_steps(df).collect()] == [(1, 1, "a", "done")]
    assert nested.trace_steps(df).first()["n_attempts"] == 2
    assert [tuple(r) for r in nested.tool_calls(df).collect()] == [(1, 0, "t", None, 1.5)]


def test_leaves(spark):
    value = '{"k": "a \\"b\\" \\u00e9", "n": [1, -2.5, true, null, {"z": "y:"}], "e": ""}'
    df = spark.createDataFrame([(1, value), (2, '"x"'), (3, ""), (4, None), (5, "[" * 5000 + "]" * 5000), (6, '["' + "x" * 200000 + '"]')], "id int, v string")
    got = {r["id"]: r["leaf_text"] for r in nested.leaf_texts(df, "id", "v").collect()}
    assert got[1] == 'a "b" é 1 -2.5 True y: ' and got[2] == "x" and got[3] is None and got[4] is None and got[5] in (None, "") and len(got[6]) == 200000


def test_scrubbing(spark):
    df = spark.createDataFrame([(1, '{"a": ["x /root/y", 2, {"b": "/root/z"}], "/root/k": null}'), (2, "{"), (3, None)], "id int, v string")
    got = {r["id"]: r["json"] for r in nested.scrub_json(df, "id", "v", lambda t: t.replace("/root/", "")).collect()}
    assert got == {1: '{"a": ["x y", 2, {"b": "z"}], "/root/k": null}', 2: None, 3: None}
