"""Labels held against what was extracted, and answers against what they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.rows import each

# A number in an answer, an equation, and words that claim it holds or doesn't.
ANSWER_NUMBER = r"[-+]?\d[\d,，]*(?:\.\d+)?%?"
EQUATION = r"([-\d,，.\s+]+)=\s*([-+]?\d[\d,，]*(?:\.\d+)?)"
DENIED = ("不等于", "不一致", "mismatch", "does not equal", "!=")
CLAIMED = ("一致", "相等", "无异常", "match", "equals")


def value_matches(rule: Column, actual: Column) -> Column:
    """Whether actual fits rule (contains, equals, one_of ARRAY), the first of them that is set; texts are compared in
    lower case with white space collapsed. A null actual fits nothing."""
    norm = T.normalized(actual)
    one_of = F.transform(rule["one_of"], T.normalized)
    fits = F.when(rule["contains"].isNotNull(), norm.contains(T.normalized(rule["contains"]))).when(rule["equals"].isNotNull(), norm == T.normalized(rule["equals"]))
    return F.coalesce(fits.otherwise(F.array_contains(one_of, norm)), F.lit(False))


def plain_number(text: Column) -> Column:
    return F.replace(T.strip(text), F.lit("$"), F.lit(""))


def numeric_evidence(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, check_no, matched, line_no): of (doc_id, check_no, text_contains, numbers) the first numeric fact that
    holds the text and all the numbers. A null text fits any fact."""
    held = facts.select("doc_id", "line_no", T.normalized(F.col("text")).alias("hay"), F.transform("numbers", plain_number).alias("has"))
    wanted = expected.select("doc_id", "check_no", T.normalized(F.coalesce("text_contains", F.lit(""))).alias("needle"), F.coalesce(F.transform("numbers", plain_number), F.array().cast("array<string>")).alias("wants"))
    hits = wanted.join(held, "doc_id").where(F.col("hay").contains(F.col("needle")) & (F.size(F.array_except("wants", "has")) == 0))
    first = hits.groupBy("doc_id", "check_no").agg(F.min("line_no").alias("line_no"))
    joined = expected.select("doc_id", "check_no").join(first, ["doc_id", "check_no"], "left")
    return joined.select("doc_id", "check_no", F.col("line_no").isNotNull().alias("matched"), "line_no")


def table_evidence(expected: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, check_no, matched, table_index): of (doc_id, check_no, text_contains, cells, min_rows, min_columns) the
    first table that holds the text and all the cells and is large enough."""
    texts = F.concat_ws(" ", F.array_join("headers", " "), F.array_join(F.flatten("body"), " "))
    held = tables.select("doc_id", "table_index", "row_count", "column_count", T.normalized(texts).alias("hay"))
    wanted = expected.select("doc_id", "check_no", T.normalized(F.coalesce("text_contains", F.lit(""))).alias("needle"), F.coalesce(F.transform("cells", T.normalized), F.array().cast("array<string>")).alias("wants"), F.coalesce("min_rows", F.lit(0)).alias("least_rows"), F.coalesce("min_columns", F.lit(0)).alias("least_columns"))
    fits = F.col("hay").contains(F.col("needle")) & F.forall("wants", lambda c: F.col("hay").contains(c)) & (F.col("row_count") >= F.col("least_rows")) & (F.col("column_count") >= F.col("least_columns"))
    first = wanted.join(held, "doc_id").where(fits).groupBy("doc_id", "check_no").agg(F.min("table_index").alias("table_index"))
    joined = expected.select("doc_id", "check_no").join(first, ["doc_id", "check_no"], "left")
    return joined.select("doc_id", "check_no", F.col("table_index").isNotNull().alias("matched"), "table_index")


def unsupported_numbers(answer: Column, corpus: Column) -> Column:
    """Numbers of answer that don't stand in corpus, neither as written nor without their commas."""
    bare = lambda x: F.translate(x, ",，", "")
    return T.bind(
        F.struct(F.coalesce(corpus, F.lit("")).alias("full"), bare(F.coalesce(corpus, F.lit(""))).alias("bare")),
        lambda c: F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(ANSWER_NUMBER), F.lit(0)), lambda n: ~(c["full"].contains(n) | c["bare"].contains(bare(n)))),
    )


def equations(df: DataFrame, key: str, answer_col: str) -> DataFrame:
    """(key, eq_no, expression, computed, reported, balanced, code): sums written out in an answer.

    code names an equation that balances while the words around it deny it, or the other way round; around is 30
    characters either way, found from the first place the expression stands in.
    """
    answer = F.col(answer_col)
    whole, left, right = (F.regexp_extract_all(answer, F.lit(EQUATION), F.lit(g)) for g in (0, 1, 2))
    rows = each(df, [key, answer_col], F.arrays_zip(whole.alias("expression"), left.alias("left"), right.alias("right")), "eq_no", "e")
    number = lambda x: F.rtrim(F.translate(x, ",，", ""), F.lit("%")).try_cast("double")
    terms = F.transform(F.regexp_extract_all("e.left", F.lit(ANSWER_NUMBER), F.lit(0)), number)
    out = rows.select(key, answer_col, "eq_no", F.col("e.expression").alias("expression"), terms.alias("terms"), number(F.col("e.right")).alias("reported"))
    out = out.where((F.size("terms") >= 2) & F.forall("terms", lambda t: t.isNotNull()) & F.col("reported").isNotNull())
    out = out.withColumn("computed", F.aggregate("terms", F.lit(0.0), lambda a, t: a + t))
    balanced = F.abs(F.col("computed") - F.col("reported")) <= F.greatest(F.lit(0.01), F.abs("reported") * 0.0001)
    at = F.position("expression", answer)
    first = F.greatest(at - 30, F.lit(1))
    around = F.substring(answer, first, at + F.length("expression") + 30 - first)
    says = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: around.contains(w))
    code = F.when(balanced & says(DENIED), "self_contradictory_arithmetic").when(~balanced & says(CLAIMED), "incorrect_arithmetic_match_claim")
    return out.select(key, "eq_no", "expression", "computed", "reported", balanced.alias("balanced"), code.alias("code"))


def answer_fingerprints(answer: Column, evidence: Column) -> tuple[Column, Column]:
    """SHA-256 of the answer, and of its evidence as a compact JSON list."""
    return F.sha2(answer, 256), F.sha2(F.to_json(evidence), 256)
