import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions import text as T


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(" ab\n\r\t\x0b\x1c\x85 　é", max_size=12), min_size=30, max_size=60))
def test_strip_lines_and_collapse_agree_with_python(spark, values):
    got = column(spark, values, T.strip(F.col("x")), T.split_lines(F.col("x")), T.estimate_tokens(F.col("x")))
    for value, (strip, lines, tokens) in zip(values, got):
        assert strip == value.strip() and lines == value.splitlines() and tokens == max(1, len(value) // 4)


@pytest.mark.parametrize(
    ("cell", "number"),
    [("1,234.50", 1234.5), ("(12)", -12.0), ("￥5", 5.0), ("3万元", 3.0), ("7 亿", 7.0), ("-3.5", -3.5), ("5%", None), ("n/a", None), ("", None), ("1.", None), (" 8 ", 8.0), ("$1,000", 1000.0), ("(1,5)", -15.0)],
)
def test_cell_number(spark, cell, number):
    assert column(spark, [cell], T.cell_number(F.col("x"))) == [(number,)]


def test_first_number(spark):
    assert column(spark, ["2026Q1", "8.05%", "B-17", "a 1,234.5 b", "none", None], T.first_number(F.col("x"))) == [(2026.0,), (8.05,), (-17.0,), (1234.5,), (None,), (None,)]


def test_clean_texts(spark):
    text = "a  b\t c\r\n\r\n\r\n\r\nd "
    assert column(spark, [text], T.clean_chunk_text(F.col("x"))) == [("a b c\n\nd",)]
    assert column(spark, ["锟斤拷aaaaaa  b\n 己完成Â "], T.clean_recovered_text(F.col("x"))) == [("aa b\n已完成",)]


def test_slug_preview_redact(spark):
    assert column(spark, ["__A b/c__", "///", None], T.slug(F.col("x"))) == [("A_b_c",), ("document",), ("document",)]
    assert column(spark, ["abcdef", "ab"], T.preview(F.col("x"), 3)) == [("abc... [6 chars]",), ("ab",)]
    secret = "Authorization: Bearer abc.def\nurl?token=xyz&x=1&X-Amz-Signature=99 api_key=k1"
    (masked,) = column(spark, [secret], T.redact(F.col("x")))[0]
    assert not re.search("abc|xyz|99|k1", masked) and "x=1" in masked


def test_tokens(spark):
    got = column(spark, ["Ab c1 财务报", "", "a|b  A"], T.profile_tokens(F.col("x")), T.lexical_tokens(F.col("x")))
    assert got[0] == (["ab", "c1", "财", "务", "报", "财务", "务报"], ["ab", "c1", "财务报"])
    assert got[1] == ([], []) and got[2][1] == ["a", "b"]


def test_parse_object(spark):
    values = ['{"k": 1}', '```json\n{"k": 2}\n```', 'say {"k": 3} please', "none", None, '{"k": }']
    got = column(spark, values, F.try_variant_get(T.parse_object(F.col("x")), "$.k", "int"))
    assert got == [(1,), (2,), (3,), (None,), (None,), (None,)]


def test_numbers_stand_alone(spark):
    got = column(spark, ["a 12 b-3 c 1,234.5% 2026-01-02 x9 7年 (8)"], T.number_tokens(F.col("x")))
    assert got == [(["12", "1,234.5%", "8"],)]


def test_ratios(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 0.0), (1.0, 0.0)], "p double, r double")
    assert [r[0] for r in df.select(T.f1(F.col("p"), F.col("r"))).collect()] == [0.5, 0.0, 0.0]
    assert [r[0] for r in df.select(T.ratio(F.col("p"), F.col("r"), 1.0)).collect()] == [1.0, 1.0, 1.0]
    assert not math.isnan(0.0)


def test_coercions_and_paths(spark):
    got = column(spark, ["7", "-3", "x", None], T.int_or(F.col("x")), T.int_or(F.col("x"), 5, None))
    assert got == [(7, 7), (0, -3), (0, 5), (0, 5)]
    assert column(spark, [" Yes", "0", None], T.truth(F.col("x")), T.choice(F.col("x"), ("0",), "d")) == [(True, "d"), (False, "0"), (False, "d")]
    assert column(spark, ["/r/a/b", "/ra", "/r/../x"], T.relative_path(F.col("x"), "/r"), T.is_confined(F.col("x"), "/r/")) == [("a/b", True), ("/ra", False), ("../x", False)]
