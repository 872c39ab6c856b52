import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import splitting


def prose(n, seed=1):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("abcdefghij"[rng.randrange(10)] * rng.randint(1, 9) for _ in range(rng.randint(4, 14))) + rng.choice([". ", ".\n", ".\n\n", "。"]))
    return "".join(out)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n.。́", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces_give_the_text_back(text, limit, overlap):
    at = 0
    ends = splitting.cuts(text, limit, overlap, 10)
    for i, (end, _) in enumerate(ends):
        assert end - max(0, at - overlap if i else 0) <= limit and (end > at or len(text) == 0)
        at = end
    assert at == len(text)


def test_an_edit_alters_neighbours_only():
    text = prose(40_000)
    before = {text[max(0, a - 50) : a] for a, _ in splitting.cuts(text)}
    edited = text[:9_000] + "some inserted words here. " + text[9_000:]
    after = {edited[max(0, a - 50) : a] for a, _ in splitting.cuts(edited)}
    assert len(before - after) <= 2


def test_cuts_stand_at_boundaries():
    kinds = [k for _, k in splitting.cuts(prose(40_000))]
    assert set(kinds) <= {"paragraph", "line", "sentence", "end"}


def test_rows(spark):
    rows = [(1, prose(9000), [3]), (1, prose(9000), [3]), (2, "short", None), (3, None, None), (4, "", []), (5, "x" * 3600, None), (6, "x" * 3601, [1, 2]), (7, "字" * 8000, None)]
    df = spark.createDataFrame(rows, "row_id bigint, chunk_text string, pages array<int>").selectExpr("*", "1 as piece", "'c' as text")
    got = splitting.split_texts(df, "row_id", "chunk_text", "pages").collect()
    assert {r["row_id"] for r in got} == {1, 6, 7}
    assert all(len(r["piece_text"]) <= 3600 for r in got)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert r["piece_text"] == texts[r["row_id"]][r["first_char"] : r["last_char"]]
        if r["piece"]:
            previous = next(x for x in got if x["row_id"] == r["row_id"] and x["piece"] == r["piece"] - 1)
            assert r["first_char"] == previous["last_char"] - 200
    assert splitting.split_texts(df.limit(0), "row_id", "chunk_text").collect() == []
    with pytest.raises(ValueError):
        splitting.split_texts(df, "row_id", "chunk_text", limit=100, overlap=100)


def test_ranges(spark):
    rows = [(1, "1-24"), (2, "第101-120页"), (3, "141-144, 147-170"), (4, "p046-p051"), (5, "pages 41 to 61"), (6, "n/a"), (7, None), (8, ""), (9, "61..81, 70-81"), (10, "30 — 1"), (11, "121")]
    df = spark.createDataFrame(rows, "range_id bigint, page_range string").selectExpr("*", "1 as pages")
    got = splitting.split_ranges(df, "range_id", "page_range").collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r["range_id"], r["piece"])):
        parts.setdefault(r["range_id"], []).append((r["first_page"], r["last_page"]))
    assert parts == {1: [(1, 20), (20, 24)], 3: [(141, 144), (147, 166), (166, 170)], 5: [(41, 60), (60, 61)], 9: [(61, 80), (80, 81)], 10: [(1, 20), (20, 30)]}


@pytest.mark.parametrize("text, spans", [("1-9999999999", []), ("1-99999999999999999999999", []), ("12345678901-3, 4-6", [(4, 6)]), ("999990-999999", [(999990, 999999)]), ("1-1000000", [])])
def test_numbers_that_name_no_page(spark, text, spans):
    df = spark.createDataFrame([(text,)], "r string")
    assert [tuple(s) for s in df.select(splitting.page_spans(df["r"])).first()[0]] == spans
