"""Key-values in texts: from lines, two-column tables and headings, with the evidence they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import ENTITY_WORDS, HEADING, KEY_HEADERS, LIST_PREFIX, NUMBER, TABLE_ROW, VALUE_HEADERS
from docmill.functions.rows import each, each_struct
from docmill.operators.documents import with_lines
from docmill.operators.tables import tables

#: Feature limits of the published result record, which say what a key-value is: characters of a line, a key, a value and a
#: paragraph, lines looked ahead; and how many are kept for a document unless `most` says otherwise.
LONGEST_LINE, LONGEST_KEY, LONGEST_VALUE, LONGEST_PARAGRAPH, AHEAD, MOST = 220, 60, 500, 180, 3, 250


def clean_line(line: Column) -> Column:
    """A line without list mark and without dashes and stars around it."""
    return T.strip(F.btrim(T.strip(F.regexp_replace(T.strip(line), LIST_PREFIX, "")), F.lit("-*")))


def is_key(key: Column) -> Column:
    number = key.rlike(f"^(?:{NUMBER})$")
    address = key.startswith("http://") | key.startswith("https://")
    return F.length(key).between(1, LONGEST_KEY) & ~number & ~address & key.rlike(r"(?U)[\w一-鿿]")


def key_value(clean: Column) -> Column:
    """(key, value) at the first full-width colon, or else at the first colon, whose left side is a key."""

    def at(mark: str) -> Column:
        spot = F.instr(clean, mark)
        key, value = F.substring(clean, F.lit(1), spot - 1), F.substring(clean, spot + 1, F.length(clean))
        pair = T.bind(T.inline_text(key), lambda k: F.when(is_key(k), F.struct(k.alias("key"), T.inline_text(value).alias("value"))))
        return F.when(spot > 0, pair)

    return F.coalesce(at("："), at(":"))


def _prepared(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(doc_id, lines, parts): of each line the clean text, its key-value and whether a paragraph stops at it."""
    parts = F.transform(
        F.transform(F.transform("lines", clean_line), lambda c: F.struct(c.alias("clean"), key_value(c).alias("pair"))),
        lambda p: p.withField("stops", p["clean"].startswith("#") | p["clean"].rlike(TABLE_ROW) | p["pair"].isNotNull()),
    )
    return with_lines(df, key, text_col).select("doc_id", "lines", parts.alias("parts"))


def _ahead(parts: Column, i: Column) -> Column:
    return F.slice(parts, i + 2, AHEAD)


def _following_lines(parts: Column, i: Column) -> Column:
    """Lines after i joined by spaces, up to an empty one or one that stops a paragraph; leading empty ones are passed."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def add(s: Column, p: Column) -> Column:
        blank = p["clean"] == ""
        ends = s["done"] | (blank & (s["text"] != "")) | (~blank & p["stops"])
        text = F.when(ends | blank, s["text"]).when(s["text"] == "", p["clean"]).otherwise(F.concat_ws(" ", s["text"], p["clean"]))
        return F.struct(text.alias("text"), ends.alias("done"))

    return T.inline_text(F.aggregate(_ahead(parts, i), start, add, lambda s: s["text"]))


def _line_rows() -> Column:
    """(at, key, value) of each of parts that reads key: value; an empty value is taken from the lines after it."""
    every = F.transform("parts", lambda p, i: F.struct(i.alias("at"), p["pair"].alias("pair"), F.length(p["clean"]).alias("size")))
    held = F.filter(every, lambda e: e["pair"].isNotNull() & (e["size"] <= LONGEST_LINE))
    return F.transform(
        held,
        lambda e: F.struct(
            e["at"].alias("at"), e["pair"]["key"].alias("key"),
            F.when(e["pair"]["value"] == "", _following_lines(F.col("parts"), e["at"])).otherwise(e["pair"]["value"]).alias("value"),
        ),
    )


def _heading_rows() -> Column:
    """(at, key, value) of each heading among lines and the first line that isn't empty among the three after it; value is
    null where that is none to take."""
    title = lambda x: F.when(x.contains("#"), T.inline_text(F.regexp_extract(T.strip(x), HEADING, 2)))
    titles = F.transform("lines", lambda x, i: F.struct(i.alias("at"), title(x).alias("key")))
    held = F.filter(titles, lambda t: F.length(t["key"]).between(1, LONGEST_KEY))

    def first(t: Column) -> Column:
        after = F.get(F.filter(_ahead(F.col("parts"), t["at"]), lambda p: p["clean"] != ""), F.lit(0))
        ok = ~after["stops"] & (F.length(after["clean"]) <= LONGEST_PARAGRAPH)
        return F.struct(t["at"].alias("at"), t["key"].alias("key"), F.when(ok, after["clean"]).alias("value"))

    return F.transform(held, first)


def line_pairs(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, key, value): a row per line that reads key: value; an empty value is taken from the lines after it."""
    return each_struct(_prepared(df, key, text_col), ["doc_id"], _line_rows(), "at")


def heading_pairs(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, key, value): a heading and the first line that isn't empty among the three after it."""
    return each_struct(_prepared(df, key, text_col), ["doc_id"], _heading_rows(), "at").where("value is not null")


def table_pairs(found: DataFrame) -> DataFrame:
    """(doc_id, at, key, value) of the rows of tables with two columns whose headers name keys or values, or hold no
    number."""
    heads = F.filter(F.transform("headers", T.strip), lambda h: h != "")
    low = F.transform(heads, F.lower)
    known = F.arrays_overlap(low, F.array(*[F.lit(w) for w in KEY_HEADERS + VALUE_HEADERS]))
    plain = (F.size(heads) == 2) & ~F.exists(heads, lambda h: h.rlike(NUMBER))
    rows = each(found, ["doc_id", "table_index"], F.when((F.col("column_count") == 2) & (known | plain), F.col("body")))
    key, value = F.get("col", F.lit(0)), F.get("col", F.lit(1))
    pairs = rows.select("doc_id", F.struct("table_index", F.col("pos").alias("row")).alias("at"), key.alias("key"), value.alias("value"))
    return pairs.where("key <> '' and value <> ''")


def key_values(df: DataFrame, key: str = "doc_id", text_col: str = "text", most: int | None = MOST) -> DataFrame:
    """(doc_id, kv_index, key, value): distinct key-values in order, those of lines first, then of tables, then of
    headings; the first `most` of each document. Null and blank texts have none."""
    # one reading of the lines gives the pairs of lines and of headings
    placed = lambda rows, source: F.transform(rows, lambda r: F.struct(F.struct(F.lit(source).alias("source"), F.lit(0).alias("table"), r["at"].alias("row")).alias("place"), r["key"].alias("key"), r["value"].alias("value")))
    own = each_struct(_prepared(df, key, text_col), ["doc_id"], F.concat(placed(_line_rows(), 0), placed(_heading_rows(), 2)), "place")
    at = F.struct(F.lit(1).alias("source"), F.col("at.table_index").alias("table"), F.col("at.row").alias("row"))
    both = own.unionByName(table_pairs(tables(df, key, text_col)).select("doc_id", at.alias("place"), "key", "value"))
    both = both.select("doc_id", "place", T.inline_text(F.col("key")).alias("key"), T.inline_text(F.col("value")).alias("value"))
    fit = both.where(F.length("key").between(1, LONGEST_KEY) & F.length("value").between(1, LONGEST_VALUE))
    first = fit.groupBy("doc_id", "key", "value").agg(F.min("place").alias("place"))
    rows = F.array_sort(F.collect_list(F.struct("place", "key", "value")))
    rows = rows if most is None else F.slice(rows, 1, most)
    numbered = each(first.groupBy("doc_id").agg(rows.alias("rows")), ["doc_id"], "rows")
    return numbered.select("doc_id", F.col("pos").alias("kv_index"), "col.key", "col.value")


def key_value_map(kv: DataFrame) -> DataFrame:
    """(doc_id, key, value_list): each key with its distinct values in the order they were found."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("kv_index", "value"))), lambda r: r["value"])
    return kv.groupBy("doc_id", "key").agg(F.array_distinct(rows).alias("value_list"))


def entity_candidates(kv: DataFrame, most: int | None = 50) -> DataFrame:
    """(doc_id, kv_index, key, value): key-values whose key names a party or a company, the first `most` of a document."""
    low = F.lower("key")
    named = kv.where(F.greatest(*[low.contains(w) for w in ENTITY_WORDS])).select("doc_id", "kv_index", "key", "value")
    if most is None:
        return named
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("kv_index"))
    return named.withColumn("no", no).where(F.col("no") <= most).drop("no")


def evidence_map(evidence: DataFrame) -> DataFrame:
    """(doc_id, key, evidence ARRAY<STRUCT<value, confidence, level, line_no, page_no, evidence_text>>): what each key stands
    on, in the order the key-values were found; empty keys have none. Key-values are limited for a document, and so are
    the arrays."""
    row = F.struct("kv_index", "value", "confidence", "level", "line_no", "page_no", "evidence_text")
    rows = evidence.where("key <> ''").groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("doc_id", "key", F.transform("rows", lambda r: r.dropFields("kv_index")).alias("evidence"))


def field_evidence(kv: DataFrame, df: DataFrame, blocks: DataFrame | None = None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kv_index, key, value, line_no, block_idx, page_no, level, confidence, evidence_text) of every key-value.

    The line is the first that holds key and value. The block is the first that holds both, or else the first that
    holds either; blocks are (doc_id, block_ord, text, page_idx, source). Without line and block the evidence is the
    pair itself. kv, lines and blocks meet by doc_id; nothing else is paired.
    """
    docs = with_lines(df, key, text_col).select("doc_id", "lines")
    both = lambda x: x.contains(F.col("key")) & x.contains(F.col("value"))
    spots = F.transform("lines", lambda x, i: F.when(both(x), i + 1))
    lined = kv.join(docs, "doc_id", "left").withColumn("line_no", F.array_min(F.filter(spots, lambda i: i.isNotNull())))
    lined = lined.withColumn("line", T.inline_text(F.get("lines", F.col("line_no") - 1))).drop("lines")
    if blocks is None:
        none = F.lit(None)
        lined = lined.withColumns({"block": F.struct(none.cast("int").alias("block_ord"), none.cast("string").alias("text"), none.cast("int").alias("page_idx"), none.cast("string").alias("source"))})
        lined = lined.withColumn("block", F.when(F.lit(False), F.col("block")))
    else:
        texts = blocks.select("doc_id", "block_ord", F.coalesce("text", F.lit("")).alias("text"), "page_idx", "source")
        pairs = kv.join(texts, "doc_id").where(F.col("text").contains(F.col("key")) | F.col("text").contains(F.col("value")))
        tier = F.when(both(F.col("text")), 0).otherwise(1)
        best = pairs.groupBy("doc_id", "kv_index").agg(F.min_by(F.struct("block_ord", "text", "page_idx", "source"), F.struct(tier, "block_ord")).alias("block"))
        lined = lined.join(best, ["doc_id", "kv_index"], "left")
    has, paged = F.col("block").isNotNull(), F.col("block.page_idx").isNotNull()
    level = F.when(paged, "page").when(has & (F.coalesce("block.source", F.lit("")) != ""), "document").when(F.col("line_no").isNotNull(), "markdown_line").otherwise("unknown")
    confidence = F.when(paged, 0.95).when(has, 0.86).when(F.col("line_no").isNotNull() & (F.length("value") >= 2), 0.72).otherwise(0.45)
    text = F.coalesce(F.nullif(T.inline_text(F.col("block.text")), F.lit("")), F.col("line"), F.concat_ws(": ", "key", "value"))
    return lined.select(
        "doc_id", "kv_index", "key", "value", "line_no", F.col("block.block_ord").alias("block_idx"), (F.col("block.page_idx") + 1).alias("page_no"),
        level.alias("level"), confidence.alias("confidence"), F.substring(text, 1, 300).alias("evidence_text"),
    )
