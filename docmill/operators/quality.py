"""Quality rules as issue rows, and the score and status they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import GARBLED
from docmill.functions.rows import each_struct

#: Points an issue of a level takes off 100.
PENALTY = {"error": 30, "warning": 8, "info": 0}


def issue(code: str, level: Column | str, when: Column) -> Column:
    level = F.lit(level) if isinstance(level, str) else level
    return F.when(when, F.struct(F.lit(code).alias("code"), level.alias("level")))


def text_rules(text: Column, native: Column | None = None, general: Column | None = None) -> list[Column]:
    """Issues that a text shows by itself: empty, garbled, short.

    native says whether the document came as text rather than as pages: it is short only below 80 characters, and never
    under the general profile. Null counts as no.
    """
    yes = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    exempt = yes(native) & (yes(general) | (F.length(T.strip(text)) >= 80))
    blank = T.strip(text) == ""
    garbled = F.regexp_count(text, F.lit(GARBLED))
    level = F.when(garbled / F.greatest(F.length(text), F.lit(1)) > 0.02, "error").otherwise("warning")
    return [
        issue("empty_markdown", "error", blank),
        issue("possible_mojibake", level, ~blank & (garbled > 0)),
        issue("short_text", "warning", ~blank & (F.length(text) < 200) & ~exempt),
    ]


def structure_rules(chars: Column, headings: Column, pairs: Column, tables: Column) -> list[Column]:
    return [issue("weak_structured_signal", "warning", (chars >= 500) & (headings == 0) & (pairs == 0) & (tables == 0))]


def page_rules(items: Column, pages: Column, native: Column) -> list[Column]:
    """Issues of block coverage: none, document level only, without pages, or too few for the blocks."""
    some = items > 0
    return [
        issue("no_content_blocks", "warning", items == 0),
        issue("document_level_provenance", "info", some & (pages == 0) & native),
        issue("no_page_provenance", "warning", some & (pages == 0) & ~native),
        issue("weak_page_provenance", "warning", (pages == 1) & (items > 30)),
    ]


def issues(df: DataFrame, *rules: Column) -> DataFrame:
    """(doc_id, code, level): a row for each rule that a document breaks."""
    return each_struct(df, ["doc_id"], F.filter(F.array(*rules), lambda x: x.isNotNull()), "code")


def score(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, infos, issue_count, score, status) of every document of docs."""
    n = lambda level: F.count_if(F.col("level") == level)
    counts = rows.groupBy("doc_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    all_docs = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["errors", "warnings", "infos"])
    return graded(all_docs)


def graded(counts: DataFrame) -> DataFrame:
    """counts with issue_count, score and status, from errors, warnings and infos."""
    points = 100 - PENALTY["error"] * F.col("errors") - PENALTY["warning"] * F.col("warnings")
    status = F.when(F.col("errors") > 0, "needs_review").when(F.col("warnings") > 0, "pass_with_warnings").otherwise("pass")
    return counts.withColumns({"issue_count": F.col("errors") + F.col("warnings") + F.col("infos"), "score": F.greatest(F.lit(0), points), "status": status})


def graded_inline(df: DataFrame, *rules: Column) -> DataFrame:
    """df with the counts, score and status of rules that need nothing but its own columns: no shuffle."""
    found = df.withColumn("issues", F.filter(F.array(*rules), lambda x: x.isNotNull()))
    n = lambda level: F.size(F.filter("issues", lambda x: x["level"] == level)).cast("bigint")
    return graded(found.withColumns({"errors": n("error"), "warnings": n("warning"), "infos": n("info")}).drop("issues"))


#: Best status first.
STATUS_RANK = {"needs_review": 0, "pass_with_warnings": 1, "pass": 2}


def best_attempt(attempts: DataFrame) -> DataFrame:
    """(doc_id, attempt_no, name, status, score) of each document's best attempt of (doc_id, attempt_no, name, status,
    score, errors, warnings): by status, then fewest points lost, score, fewest warnings; ties keep the earlier."""
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    lost = PENALTY["error"] * F.col("errors") + PENALTY["warning"] * F.col("warnings")
    by = F.struct(F.try_element_at(rank, F.col("status")), -lost, F.col("score"), -F.col("warnings"), -F.col("attempt_no"))
    best = attempts.groupBy("doc_id").agg(F.max_by(F.struct("attempt_no", "name", "status", "score"), by).alias("b"))
    return best.select("doc_id", "b.*")
