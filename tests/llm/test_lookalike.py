from docmill.llm import lookalike


def pairs(spark, texts, extra=()):
    df = spark.createDataFrame([("t", i, t, "x", "y") for i, t in enumerate(texts)], "tbl string, id bigint, text string, form string, look string")
    return {(r["id_a"], r["id_b"]) for r in lookalike.alike_pairs(df, ["tbl", "id"], "text").collect()}


def test_what_looks_the_same(spark):
    base = "Page é 12-3, ok"
    same = ["Ｐａｇｅ é １２－３， ok", "Page é 12-3, ok", "P​age é 12-3, ok﻿", "Раgе é 12-3, оk", "Page　é 12-3, οk"]
    assert pairs(spark, [base, *same]) == {(i, j) for i in range(6) for j in range(i + 1, 6)}


def test_what_a_reader_can_tell_apart(spark):
    texts = ["Page 2 ok", "page 2 ok", "Page ² ok", "Pagé 2 ok", "Page 2  ok", "Page 2. ok", "Page\n2 ok", "Page \x85 2 ok", "Page \x86 2 ok"]
    assert pairs(spark, texts) == set()


def test_radicals_and_accented_lookalikes(spark):
    assert pairs(spark, ["⾦额", "金额", "ѐtat", "ètat", "ètat"]) == {(0, 1), (2, 3), (2, 4), (3, 4)}


def test_copies_blanks_and_tables_stay_apart(spark):
    assert pairs(spark, [None, "", "  ", "​", "same", "same", "ѕame"]) == {(4, 6), (5, 6)}
    df = spark.createDataFrame([("a", 1, "x y"), ("b", 2, "x y")], "tbl string, id bigint, text string")
    assert lookalike.alike_pairs(df, ["tbl", "id"], "text").collect() == []
    assert lookalike.alike_pairs(df.limit(0), ["tbl", "id"], "text").collect() == []


def test_canonical_is_the_text_most_rows_store(spark):
    texts = ["a b", "a b", "a b", None, "", "Привет мир", "Привет мир", "Пpивет мир", "x" * 50000]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tbl string, id bigint, text string")
    got = {r["id"]: r["canonical"] for r in lookalike.canonical_texts(df, ["tbl", "id"], "text").collect()}
    assert got[0] == got[1] == got[2] == "a b" and got[3] is None and got[4] == ""
    assert got[7] == "Привет мир" and got[8] == "x" * 50000 and len(got) == len(texts)
