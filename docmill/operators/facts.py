"""Numbers, dates and signal lines found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import ANOMALY_WORDS, DATE, NUMBER, RECOMMENDATION_WORDS, REFERENCE
from docmill.functions.rows import each, each_struct
from docmill.operators.documents import sections, with_lines

#: Feature limits of the published result record: rows kept for each document, in order; most=None keeps all. LONGEST is
#: the length of the quoted line; longest=None quotes it whole.
MOST_FACTS, MOST_SIGNALS, MOST_REFERENCES, LONGEST = 500, 50, 100, 300


def numeric_facts(df: DataFrame, key: str = "doc_id", text_col: str = "text", most: int | None = MOST_FACTS, longest: int | None = LONGEST) -> DataFrame:
    """(doc_id, line_no, text, numbers): lines that hold numbers, without tags, the first `most` of each document."""
    clean = F.transform("lines", lambda x: T.inline_text(F.regexp_replace(x, "<[^>]+>", " ")))
    found = F.transform(F.col("clean"), lambda x, i: F.struct((i + 1).alias("line_no"), (x if longest is None else F.substring(x, 1, longest)).alias("text"), T.number_tokens(x).alias("numbers")))
    kept = F.filter(found, lambda f: F.size(f["numbers"]) > 0)
    kept = kept if most is None else F.slice(kept, 1, most)
    numbered = with_lines(df, key, text_col).where(F.col("text").rlike(r"\d")).select("doc_id", clean.alias("clean"))
    return each_struct(numbered, ["doc_id"], kept, "line_no")


def dates(df: DataFrame, key: str = "doc_id", text_col: str = "text", most: int | None = MOST_SIGNALS) -> DataFrame:
    """(doc_id, date_no, date): distinct dates as written, in the order they first stand in."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(DATE), F.lit(0)))
    found = found if most is None else F.slice(found, 1, most)
    return each(df, [F.col(key).alias("doc_id")], found).select("doc_id", (F.col("pos") + 1).alias("date_no"), F.col("col").alias("date"))


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of the words, as any part of it."""
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def signal_lines(df: DataFrame, key: str = "doc_id", text_col: str = "text", words: tuple[str, ...] = ANOMALY_WORDS, most: int | None = MOST_SIGNALS, longest: int | None = LONGEST) -> DataFrame:
    """(doc_id, line_no, text): lines that hold one of the words in any case, the first `most` of each document."""
    flat = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), T.strip(x).alias("full")))
    kept = F.filter(flat, lambda s: holds_any(F.lower(s["full"]), words))
    kept = kept if most is None else F.slice(kept, 1, most)
    hits = with_lines(df, key, text_col).where(holds_any(F.lower("text"), words))
    hits = each_struct(hits, ["doc_id"], kept, "line_no")
    return hits.select("doc_id", "line_no", (F.col("full") if longest is None else F.substring("full", 1, longest)).alias("text"))


def field_coverage(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, has_date, has_recommendation, has_anomaly_signal) of every row: whether the text holds a date, and one of
    the words that recommendations and anomaly lines are known by. One projection, no shuffle; null and empty texts hold
    nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    return df.select(
        F.col(key).alias("doc_id"), text.rlike(DATE).alias("has_date"), holds_any(low, RECOMMENDATION_WORDS).alias("has_recommendation"),
        holds_any(low, ANOMALY_WORDS).alias("has_anomaly_signal"),
    )


def recommendations(df: DataFrame, key_values: DataFrame, key: str = "doc_id", text_col: str = "text", most: int | None = MOST_SIGNALS) -> DataFrame:
    """(doc_id, rec_no, source, text): key-values whose key asks for action, then lines that do and aren't one of them."""
    named = key_values.where(holds_any(F.lower("key"), RECOMMENDATION_WORDS))
    named = named.select("doc_id", F.lit(0).alias("rank"), F.col("kv_index").alias("at"), F.lit("key_value").alias("source"), F.concat_ws(": ", "key", "value").alias("text"))
    lines = signal_lines(df, key, text_col, RECOMMENDATION_WORDS, None)
    fresh = lines.join(named.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")
    fresh = fresh.select("doc_id", F.lit(1).alias("rank"), F.col("line_no").alias("at"), F.lit("line").alias("source"), "text")
    rows = F.array_sort(F.collect_list(F.struct("rank", "at", "source", "text")))
    rows = rows if most is None else F.slice(rows, 1, most)
    each_rec = named.unionByName(fresh).groupBy("doc_id").agg(rows.alias("rows"))
    each_row = each(each_rec, ["doc_id"], "rows")
    return each_row.select("doc_id", (F.col("pos") + 1).alias("rec_no"), "col.source", "col.text")


def references(df: DataFrame, key: str = "doc_id", text_col: str = "text", most: int | None = MOST_REFERENCES) -> DataFrame:
    """(doc_id, source_title, source_line, reference_text, target_page, target_hint, relation, confidence): references
    from section texts to pages, attachments and what stands above or below."""
    found = sections(df, key, text_col).select("doc_id", "section_no", "title", "line", T.inline_text(F.col("text")).alias("body"))
    found = found.where(F.col("body").rlike(REFERENCE))
    every = lambda g: F.regexp_extract_all("body", F.lit(REFERENCE), F.lit(g))
    zipped = F.arrays_zip(every(0).alias("whole"), every(2).alias("page"), every(3).alias("attachment"))
    hits = each(found, ["doc_id", "section_no", "title", "line"], zipped, "ref_no", "hit")
    whole, page = F.col("hit.whole"), F.nullif(F.col("hit.page"), F.lit("")).cast("int")
    hint = F.coalesce(*[F.when(whole.contains(w), w) for w in ("上文", "前述", "上述", "同上", "上一节", "下表", "上表")])
    relation = (
        F.when(whole.contains("下表") | whole.contains("上表"), "table_reference")
        .when(whole.contains("附件"), "attachment_reference")
        .when(whole.contains("第") & whole.contains("页"), "page_reference")
        .otherwise("context_reference")
    )
    row = F.struct(
        "section_no", "ref_no", F.col("title").alias("source_title"), F.col("line").alias("source_line"), whole.alias("reference_text"), page.alias("target_page"),
        F.coalesce(F.nullif(F.col("hit.attachment"), F.lit("")), hint).alias("target_hint"), relation.alias("relation"),
        F.when(page.isNull() | (page == 0), 0.56).otherwise(0.78).alias("confidence"),
    )
    rows = F.array_sort(F.collect_list(row))
    kept = hits.groupBy("doc_id").agg((rows if most is None else F.slice(rows, 1, most)).alias("rows"))
    return each_struct(kept, ["doc_id"], "rows", "ref_no").drop("section_no", "ref_no")
