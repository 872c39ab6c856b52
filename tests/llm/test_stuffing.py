import pytest

from docmill.llm import stuffing

SENTENCE = "The reviewer noted that the column replaces a part of the manual balance. "
SPAM = [
    " ".join(f"label printer {x} annual report sample" for x in "abcdefghijkl"),
    "\n".join(f"ledger software N{i}" for i in range(15)),
    "档案盒 报表生成器 档案盒 代理记账 档案盒 打印耗材 电子签章 档案盒 电子签章 档案盒 代理记账 档案盒 电子签章 代理记账",
    "\n".join(f"Permanent Signature » www.site{i}.example" for i in range(8)),
    "\n".join(f'<a href="https://a{i}.test/x">Manual Item {i}</a>' for i in range(8)),
    "#pdfconverter #ocrsoftware #pdfconverter #pdfconverter #ocrsoftware77 #pdfconverter",
    "\n".join(f"item{i} archive = {i}11,611.55 budget sheet" for i in range(9)),
    "Tags: size 29; stamp maker; LX-79573; DB-79797; size 3; 80g; blue; size 7; A4; receipt app; size 11; AB-1234; CD-5678; blue; blue; EF-9012",
    "# 图纸打印\n\n在线 财务软件! 最好的 档案盒! 最好的 合同模板! 订 档案盒! 订 合同模板! 便宜 合同模板! 最好的 档案盒! 在线 财务软件!",
    "buy tax form! best tax form! best scanner deal! online tax form! tax form order! get tax form!",
]
PAGES = [
    SENTENCE * 4,
    SENTENCE * 3 + "\n\n" + "\n".join(f"[{i}] https://site{i}.test/a" for i in range(3)),
    "\n".join(f"- {SENTENCE}See [the batch](https://a{i}.test) for the full text of the report." for i in range(4)),
    "| Item | 2026 | 2025 |\n| --- | --- | --- |\n" + "\n".join(f"| clause {chr(97 + i)} | {i}2,1{i} | 4{i} |" for i in range(9)),
    SENTENCE * 3 + "#report #balance",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, url string").selectExpr("*", "1 as id", "'h' as host", "true as spam")


def names(k, n):
    """n words that no other page holds."""
    return [f"{chr(97 + k // 26)}{chr(97 + k % 26)}w{chr(97 + i // 26)}{chr(97 + i % 26)}name" for i in range(n)]


def edition(text, k):
    """text with lines of its own, as pages of one sort differ from host to host."""
    return "\n".join([text, *names(k, 6)])


def spam_of(spark, rows, **settings):
    return {r["doc_id"]: r["spam"] for r in stuffing.page_spam(frame(spark, rows), "doc_id", **settings).collect()}


@pytest.mark.parametrize("lead", ["", SENTENCE + "\n\n", "# Heading\n\n"])
def test_flags(spark, lead):
    rows = [(10 * i + k, lead + edition(t, 10 * i + k) * (3 if lead.startswith("The") else 1), f"https://h{k}.example/x") for i, t in enumerate(SPAM) for k in range(4)]
    rows += [(1000 + 10 * i + k, edition(t, 300 + 10 * i + k), f"https://h{k}.example/x") for i, t in enumerate(PAGES) for k in range(4)]
    rows += [(2000, None, None), (2001, "", None), (2002, " \n", None), (2003, rows[0][1], None)]
    got = spam_of(spark, rows)
    assert sorted(i for i, spam in got.items() if spam) == [*sorted(10 * i + k for i in range(len(SPAM)) for k in range(4)), 2003]
    assert len(got) == len(rows) - 3


def test_hosts_decide(spark):
    """One and the same pages are spam where their phrases are repeated on three hosts, and not where on two, by two
    contents only, or by copies of one content."""
    page = "\n".join(f"ledger software {x}" for x in names(99, 9))
    editions = [edition(page, k) for k in range(4)]
    on = lambda texts, hosts: set(spam_of(spark, [(i, t, f"https://h{i % hosts}.example") for i, t in enumerate(texts)]).values())
    assert on(editions, 4) == on(editions, 3) == {True}
    assert on(editions, 2) == on(editions[:2] * 3, 6) == on([page] * 9, 9) == {False}


def test_phrases_held_once_by_most_pages_are_no_stuffing(spark):
    """A phrase that ordinary pages hold once is one of theirs, whatever a few pages repeat."""
    few = [(i, "\n".join(f"scan report {x}" for x in names(50 + i, 5)), f"https://h{i}.example") for i in range(4)]
    many = [(100 + i, "\n".join(["scan report", *names(20 + i, 8)]), f"https://h{i}.example") for i in range(12)]
    assert set(spam_of(spark, few).values()) == {True}
    assert set(spam_of(spark, few + many).values()) == {False}


def test_pages_stitched_of_others_phrases_need_not_repeat_them(spark):
    keywords = ["stamp maker", "ledger software", "label printer", "tax form", "budget sheet", "receipt app"]
    stuffed = [(i, edition("\n".join(k for k in keywords for _ in range(4)), i), f"https://h{i}.example") for i in range(4)]
    once = (50, "\n".join(keywords), "https://z.example")
    plain = (51, "\n".join(names(200, 12)), "https://z.example")
    got = spam_of(spark, [*stuffed, once, plain])
    assert got[50] and not got[51]


def test_phrases_run_on_over_line_breaks_and_not_over_sentences():
    words = [f"keyword{chr(97 + i)}" for i in range(9)]
    one, many = stuffing.page_phrases(" ".join(words))[2], stuffing.page_phrases("\n\n".join(words))[2]
    assert sorted(one) == sorted(many) and len(one) == 8 + 9
    parted = stuffing.page_phrases("\n".join(words[:4]) + "\n\n" + SENTENCE + "\n\n" + "\n".join(words[4:8]))[2]
    assert len(parted) == 3 + 3 + 8


def test_masks():
    assert stuffing.masked_words("KX-77413 | stamp maker | A4 12,50 labelprinter14 2024-05-15 80g") == (["\x02", "stamp", "maker", "\x02", "labelprinter", "\x02"], [])
    assert stuffing.masked_words("<a href='https://x.test/a'>Item</a> www.b.test #tagword9 #5")[0] == ["\x01", "item", "\x01", "\x03", "tagword"]
    assert stuffing.masked_words("a\x01b")[0] == ["a", "b"]


def test_titles_of_links_are_masked():
    page = lambda name: stuffing.page_phrases("\n".join(f"{name}{i} {name} www.site.test" for i in "abcd"))[2]
    template = lambda rows: {r[0] for r in rows if r[1] == stuffing.TEMPLATE}
    assert template(page("one")) == template(page("two")) and len(template(page("one"))) == 1


def test_a_phrase_on_every_page_is_split(spark):
    rows = [(i, edition("tax form\n" * 4, i % 600), f"https://h{i % 50}.example") for i in range(600)]
    df = frame(spark, rows)
    assert all(r["spam"] for r in stuffing.page_spam(df, "doc_id").collect())
    assert "salt" in stuffing.stuffed_phrases(stuffing.pages(df, "doc_id", "text", "url"))._jdf.queryExecution().toString()


def test_tables_and_forms_that_repeat_a_word_are_pages(spark):
    texts = ["Pump A\nPump B\nPump C\nPump D", "| open | 1 |\n| open | 2 |\n| closed | 3 |\n| open | 4 |", "- the deposit\n- the claim\n- the audit\n- the scan"]
    rows = [(i, t, "https://a.example") for i, t in enumerate(texts)]
    assert not any(spam_of(spark, rows).values())


def test_an_empty_table(spark):
    assert stuffing.page_spam(frame(spark, []), "doc_id").collect() == []


def test_a_very_long_text(spark):
    rows = [(1, SENTENCE * 5000, "https://a.example")] + [(2 + k, edition("stamp maker " * 30000, k), f"https://h{k}.example") for k in range(3)]
    assert spam_of(spark, rows) == {1: False, 2: True, 3: True, 4: True}
