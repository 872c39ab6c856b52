from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=200), st.integers(1, 5))
def test_windows_hold_every_item_once_within_capacity(sizes, windows):
    packer, out = packing.WindowPacker(20, windows), []
    for i, size in enumerate(sizes):
        for piece, (_, n) in enumerate(packing.cut_oversized(size, 20)):
            out += packer.add((i, piece, n), n)
            assert len(packer.items) <= windows
    out += packer.rest()
    held = [x for _, items in out for x in items]
    assert len({number for number, _ in out}) == len(out)
    assert all(sum(x[2] for x in items) <= 20 for _, items in out)
    assert sorted(held) == sorted((i, p, n) for i, s in enumerate(sizes) for p, (_, n) in enumerate(packing.cut_oversized(s, 20)))


def test_best_fit_and_fullest():
    packer = packing.WindowPacker(10, 2)
    assert packer.add("a", 6) == [] and packer.add("b", 7) == []
    assert packer.add("c", 3) == [(1, ["b", "c"])]  # the tighter of the two
    assert packer.add("d", 8) == []
    assert packer.add("e", 9) == [(2, ["d"])]  # none fits: the fullest goes


@pytest.mark.parametrize("capacity", [5, 64])
def test_whole_table(spark, capacity):
    rows = [(i, "word " * (i % 40), "clash") for i in range(400)] + [(400, None, ""), (401, "", ""), (1, "word ", ""), (402, "token " * 500, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(4)
    got = packing.pack_texts(df, capacity=capacity, windows=4, fan_in=2).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r["container_id"]].append(r)
    assert all(sum(x["n_tokens"] for x in w) == w[0]["used"] <= capacity for w in windows.values())
    assert all(sorted(x["slot"] for x in w) == list(range(len(w))) for w in windows.values())
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
    assert set(pieces) == {r[0] for r in rows}
    for doc, parts in pieces.items():
        if doc != 1 and sum(p[2] for p in parts) > capacity:
            parts.sort()
            assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))] and all(p[2] == capacity for p in parts[:-1])
        elif doc != 1:
            assert len(parts) == 1
    assert len(pieces[1]) == 2  # a repeated row is packed twice


def test_texts_without_tokens_fill_nothing(spark):
    df = spark.range(30000).selectExpr("id as doc_id", "case when id % 3 = 0 then '' when id % 3 = 1 then null else 'word word' end as text").coalesce(2)
    got = packing.pack_texts(df, capacity=64)
    assert got.count() == 30000
    empty = got.where("n_tokens = 0").groupBy("container_id").agg({"slot": "max", "used": "max", "doc_id": "count"}).collect()
    assert len(empty) == 2 and all(r["max(used)"] == 0 and r["max(slot)"] == r["count(doc_id)"] - 1 for r in empty)


def test_empty_table_and_bad_arguments(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_texts(df).collect() == []
    with pytest.raises(ValueError):
        packing.pack_texts(df, capacity=0)
