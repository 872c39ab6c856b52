"""The full structured view of every document: all that the extraction operators find, as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators import documents, facts, keyvalues, tables

PREVIEW = 2000


def _gathered(rows: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """(doc_id, name): the rows of each document as an array of structs in order."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item"))))
    return rows.groupBy("doc_id").agg(F.transform(held, lambda r: r["item"]).alias(name))


def full_view(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sections, tables, key_values, numeric_facts, dates, anomaly_lines, recommendations, references,
    heading_count, fallback_count, markdown_preview), one row for each distinct doc_id; arrays are null where nothing was found.

    Every part is joined by doc_id, so one exchange layout serves all; the parts are capped per document as their
    operators say, which bounds the arrays.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, PREVIEW).alias("markdown_preview"))
    found_sections, found_tables, pairs = documents.sections(df, key, text_col), tables.tables(df, key, text_col), keyvalues.key_values(df, key, text_col)
    kinds = found_sections.groupBy("doc_id").agg(F.count_if(F.col("source") == "heading").alias("heading_count"), F.count_if(F.col("source") == "fallback").alias("fallback_count"))
    parts = [
        _gathered(found_sections, "sections", ["section_no"], ["level", "title", "line", "text", "source"]),
        _gathered(found_tables, "tables", ["table_index"], ["start_line", "headers", "body", "row_count", "column_count", "header_levels"]),
        _gathered(pairs, "key_values", ["kv_index"], ["key", "value"]),
        _gathered(facts.numeric_facts(df, key, text_col), "numeric_facts", ["line_no"], ["line_no", "text", "numbers"]),
        _gathered(facts.dates(df, key, text_col), "dates", ["date_no"], ["date"]),
        _gathered(facts.signal_lines(df, key, text_col), "anomaly_lines", ["line_no"], ["line_no", "text"]),
        _gathered(facts.recommendations(df, pairs, key, text_col), "recommendations", ["rec_no"], ["source", "text"]),
        _gathered(facts.references(df, key, text_col), "references", ["source_line", "reference_text"], ["source_title", "reference_text", "target_page", "target_hint", "relation", "confidence"]),
        kinds,
    ]
    out = docs.dropDuplicates(["doc_id"])
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0, ["heading_count", "fallback_count"])
