"""Documents as rows with their lines in an array: what follows works inside the row, without a shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import HEADING
from docmill.functions.rows import each, each_struct


def with_lines(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, lines): null text counts as empty; each row stays one row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("doc_id"), text.alias("text")).withColumn("lines", T.split_lines(F.col("text")))


def lines(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): a row per line, counted from 1; none for empty and null texts."""
    flat = each(with_lines(df, key, text_col), ["doc_id"], "lines")
    return flat.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def heading_marks(lines: Column) -> Column:
    """(pos, level, title) of each line that is a heading, pos from 0."""
    every = F.transform(
        lines,
        lambda x, i: F.struct(
            i.alias("pos"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), T.strip(F.regexp_extract(x, HEADING, 2)).alias("title")
        ),
    )
    return F.filter(every, lambda h: h["level"] > 0)


def sections(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section_no, level, title, line, text, source): a row per heading with the text up to the next one.

    Text before the first heading belongs to no section. A text without headings gives one row of source `fallback`,
    titled `document`, without line; a blank or null one gives none.
    """
    marked = with_lines(df, key, text_col).withColumn("marks", heading_marks(F.col("lines")))

    def body(h: Column, k: Column) -> Column:
        after = F.coalesce(F.get("marks", k + 1)["pos"], F.size("lines"))
        return F.struct(
            (k + 1).alias("section_no"), h["level"].alias("level"), h["title"].alias("title"), (h["pos"] + 1).alias("line"),
            T.strip(F.array_join(F.slice("lines", h["pos"] + 2, after - h["pos"] - 1), "\n")).alias("text"),
            F.lit("heading").alias("source"),
        )

    none = F.struct(
        F.lit(1).alias("section_no"), F.lit(1).alias("level"), F.lit("document").alias("title"), F.lit(None).cast("int").alias("line"),
        T.strip(F.col("text")).alias("text"), F.lit("fallback").alias("source"),
    )
    found = F.when(F.size("marks") > 0, F.transform("marks", body)).when(T.strip(F.col("text")) != "", F.array(none))
    return each_struct(marked, ["doc_id"], found, "section_no")


def composed(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts in Unicode form NFC. SQL has no such function, so texts go through Arrow batches; those that
    are in the form already, nearly all, are told by a quick check and kept. Null stays null; nothing is shuffled."""
    src = df.select(F.col(key).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def recovered_texts(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): composed texts with noise removed, misread characters put right and repeats cut; null texts come
    out empty."""
    return composed(df, key, text_col).withColumn("text", T.clean_recovered_text(F.col("text")))
