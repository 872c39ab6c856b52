from pyspark.sql import functions as F

from docmill.operators import blocks, evaluation, facts, tables


def test_value_rules(spark):
    data = [("Net  Profit", None, None, "net profit"), ("b", None, None, "a B c"), (None, "x y", None, "X  y"), (None, None, ["q", "R"], "r"), (None, "x", None, None), (None, "x", None, "y")]
    df = spark.createDataFrame([(i, (c, e, o), a) for i, (c, e, o, a) in enumerate(data)], "i int, rule struct<contains:string,equals:string,one_of:array<string>>, actual string")
    assert [r[0] for r in df.orderBy("i").select(evaluation.value_matches(F.col("rule"), F.col("actual"))).collect()] == [True, True, True, True, False, False]


def test_numeric_and_table_evidence(spark):
    text = "Profit was 12 and 1,300\nProfit was 12\n| a | b |\n| total | 5 |\n| x | 6 |"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    wanted = spark.createDataFrame([(1, 0, "profit", ["12", "$1,300"]), (1, 1, "profit", ["13"]), (1, 2, None, ["12"]), (2, 0, "x", None)], "doc_id int, check_no int, text_contains string, numbers array<string>")
    got = {(r["doc_id"], r["check_no"]): (r["matched"], r["line_no"]) for r in evaluation.numeric_evidence(wanted, facts.numeric_facts(docs)).collect()}
    assert got == {(1, 0): (True, 1), (1, 1): (False, None), (1, 2): (True, 1), (2, 0): (False, None)}
    wanted = spark.createDataFrame([(1, 0, "total", ["6"], 2, 2), (1, 1, "total", None, 3, None), (1, 2, None, ["zz"], None, None)], "doc_id int, check_no int, text_contains string, cells array<string>, min_rows int, min_columns int")
    got = {r["check_no"]: r["matched"] for r in evaluation.table_evidence(wanted, tables.tables(docs)).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_answers(spark):
    df = spark.createDataFrame([(1, "about 1,200 and 7%", "total 1200, share 8%"), (2, None, "x"), (3, "5", None)], "i int, answer string, corpus string")
    assert [r[0] for r in df.orderBy("i").select(evaluation.unsupported_numbers(F.col("answer"), F.col("corpus"))).collect()] == [["7%"], [], ["5"]]
    sums = spark.createDataFrame([(1, "10+20=30 does not equal the total. Then 1 + 2 = 4, they match"), (2, "x = 5"), (3, None), (4, "1,000+1=1,001")], "i int, answer string")
    got = sorted((r["i"], r["balanced"], r["code"]) for r in evaluation.equations(sums, "i", "answer").collect() if r["i"] != 1)
    assert got == [(4, True, None)]
    both = {r["eq_no"]: r["code"] for r in evaluation.equations(sums.where("i = 1"), "i", "answer").collect()}
    assert both == {0: "self_contradictory_arithmetic", 1: "incorrect_arithmetic_match_claim"}


def test_blocks_of_text(spark):
    text = "# T\nline one\nline two\n- a\n2) b\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter\n<table>\n# inside\n</table>\n<table></table>\n| no | separator |\n\n\nend"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r["type"], r["text"]) for r in blocks.text_blocks(df).orderBy("block_idx").collect()]
    assert got == [
        ("heading", "# T"), ("text", "line one\nline two"), ("list", "- a\n2) b"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("text", "after"),
        ("table", "<table>\n# inside\n</table>"), ("table", "<table></table>"), ("text", "| no | separator |"), ("text", "end"),
    ]
