import pytest

from docmill.llm import prose

SENTENCES = [
    "The reviewer noted that the column replaces a part of the manual balance.",
    "A partial scan dated 2025-12-15 supports both the subtotal and the page",
    "盘点结果在多次重试之后再次引用单元格内容。",
    "Годовой отчёт ограничивает список замечаний вне срока.",
    "EACH EXTERNAL BLUEPRINT MUST BE FILED WITH THE DEPOSIT AFTER TWO FAILED ATTEMPTS.",
    "Le dÃ©pÃ´t central complÃ¨te le montant hors taxe.",
    "Fіlе S10815 аррlіеѕ аnd thе rеаdіng wаѕ tаkеn.",
    "Diese Seite wurde bewusst frei gelassen.",
]
OTHER = [
    "1.1 die Kürzung ........ 3\n1.2 das Gutachten ............... 5",
    "□ das Gutachten NN-18008\n□ die offene Forderung\n□ das fehlende Blatt",
    "保修期限\n违约责任\n责任范围\n标题层级",
    "| Item | 2026 | 2025 |\n| --- | --- | --- |\n| urgent balance | 1 | 2 |",
    "Document key: PA-92420\nDate: 2023-09-18\nStatus: open",
    "94a80b525ea9e2a6fcc4a52b04e7c2f9ac0201c5569263cd415ea4ce30de293e",
    "\\. ~/\\)' {]):'¦.\nI i+; .}¦_^§>-'¦=[==1.'+*#;|}|i)<|_{{~`",
    "les clauses générales; les frais engagés; le coût estimé; l'ancien modèle",
    "1. 利润分配\n2. 违约责任 FC-65809\n3. 管道的读数",
]


@pytest.mark.parametrize("text", SENTENCES)
def test_sentences_are_found(text):
    assert prose.text_stats(text)[-1] > 0


@pytest.mark.parametrize("text", OTHER)
def test_lists_tables_and_noise_hold_none(text):
    assert prose.text_stats(text)[-1] == 0


def test_figures():
    lang, words, length, symbols, closed, common, strength, share, n = prose.text_stats("The old cat sat.\nOn the mat, it was!")
    assert (lang, words, n) == ("en", 9, 2) and closed == 1.0 and share == 1.0
    assert length == pytest.approx(25 / 9) and symbols == pytest.approx(3 / 28) and common == pytest.approx(5 / 9)


def test_tails(spark):
    rows = [(i, "The reviewer noted that the balance was right. It is on the page that we have read.", "text") for i in range(60)]
    rows += [(100 + i, t, "text") for i, t in enumerate(OTHER)] + [(200, None, "text"), (201, "", "text"), (202, " \n", "text"), (203, "The list is on the page. " * 3000, "text")]
    df = spark.createDataFrame(rows, "row_id bigint, chunk_text string, content_type string").selectExpr("*", "'x' as lang", "'y' as text")
    got = {r["row_id"]: r for r in prose.quality_stats(df.drop("lang", "text"), "row_id", "chunk_text", "content_type").collect()}
    assert {i for i, r in got.items() if r["tail"]} >= {100 + i for i in range(len(OTHER))} and not any(got[i]["tail"] for i in (*range(60), 203))
    assert got[200]["words"] == got[201]["words"] == got[202]["words"] == 0 and len(got) == len(rows)


@pytest.mark.parametrize("lists", [20, 45, 200])
def test_tails_do_not_depend_on_how_common_lists_are(spark, lists):
    prose_texts = ["The reviewer noted that the balance was right. It is on the page that we have read.", "1. item\n2. item\n3. The reviewer noted that the balance was right."]
    rows = [(i, prose_texts[i % 2]) for i in range(90)] + [(1000 + i, "1. the deposit\n2. the claim\n3. the audit") for i in range(lists)]
    got = prose.quality_stats(spark.createDataFrame(rows, "row_id bigint, chunk_text string"), "row_id", "chunk_text").where("tail").collect()
    assert {r["row_id"] for r in got} == {1000 + i for i in range(lists)}


def test_the_sketches_decide(spark):
    """One and the same short line is prose where a language's sentences are short, and in the tail where they are long."""
    line = "The audit is open."
    short = [(i, f"The {w} is shut.") for i, w in enumerate(["door", "file", "case", "book"] * 20)]
    long = [(i, f"The reviewer noted that the {w} was right and that it is on the page which we have read before the audit was done.") for i, w in enumerate(["door", "file"] * 40)]
    tail_of = lambda rows: prose.quality_stats(spark.createDataFrame([*rows, (999, line)], "row_id bigint, chunk_text string"), "row_id", "chunk_text").where("row_id = 999").first()["tail"]
    assert not tail_of(short) and tail_of(long)


def test_full_stops_of_abbreviations_end_nothing():
    whole = prose.text_stats("In the annex, the trace no. 86205 documents an amount of 33 that we have read.")
    assert whole[-1] == 1


def test_tails_where_no_row_is_prose(spark):
    rows = [(1, "1. the deposit\n2. the claim"), (2, "1. der Antrag\n2. die Frist"), (3, "** ** **")]
    got = prose.quality_stats(spark.createDataFrame(rows, "row_id bigint, chunk_text string"), "row_id", "chunk_text").where("tail").collect()
    assert {r["row_id"] for r in got} == {1, 2, 3}


def test_sketches_merge_to_the_quantiles(spark):
    df = spark.range(2000).selectExpr("id as row_id", "concat_ws(' ', transform(sequence(1, cast(id % 100 as int) + 1), x -> 'the')) as chunk_text").repartition(7)
    stats = prose.with_tails(s := prose.document_stats(df, "row_id", "chunk_text"), prose.stat_sketches(s))
    rows = stats.select("words", "words_rank").distinct().collect()
    assert all(abs(r["words_rank"] - r["words"] / 100) <= 0.06 for r in rows)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, chunk_text string")
    assert prose.quality_stats(df, "row_id", "chunk_text").collect() == []
