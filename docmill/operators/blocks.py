"""Content blocks: made from text, summed up, and cut into retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import LOW_VALUE_SECTION
from docmill.functions.rows import each
from docmill.operators.documents import sections, with_lines
from docmill.operators.tables import tables

# Block types by what becomes of them.
NOISE_TYPES = ("page_header", "page_footer", "page_number", "header", "footer", "page_aside_text", "aside_text")
HEADING_TYPES = ("title", "heading")
CONTENT_TYPES = {
    "text": ("text", "paragraph", "list", "list_item", "page_footnote", "title"),
    "table": ("table",),
    "figure": ("image", "figure"),
    "formula": ("equation_interline", "equation_inline", "formula"),
}
#: Estimated tokens at which buffered text becomes a chunk, and beyond which a text is split.
FLUSH_TOKENS, MOST_TOKENS = 650, 900


def content_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, item_count, page_count, provenance_level, text_characters, type_counts) of blocks (doc_id, type, text,
    page_idx); counts by type are `type=n` in order, joined by commas."""
    by_type = blocks.groupBy("doc_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.collect_set("page_idx").alias("pages")
    )
    pages = F.size(F.array_distinct(F.flatten(F.collect_list("pages"))))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda t: F.concat_ws("=", t["type"], t["n"].cast("string"))), ",")
    out = by_type.groupBy("doc_id").agg(F.sum("n").alias("item_count"), pages.alias("page_count"), F.sum("chars").alias("text_characters"), counts.alias("type_counts"))
    return out.withColumn("provenance_level", F.when(F.col("page_count") > 0, "page").otherwise("document"))


# What opens a block of each kind, on a stripped line.
BLOCK_HEADING = r"^#{1,6}(?U:\s)+\S"
BLOCK_LIST = r"^(?:[-*+]|\d+[.)])(?U:\s)+\S"
BLOCK_SEPARATOR = r"^\|?(?U:\s)*:?-{3,}:?(?U:\s)*(?:\|(?U:\s)*:?-{3,}:?(?U:\s)*)++\|?$"
BLOCK_HTML = r"(?i)<table(?:\s|>|$)"


def line_kinds(lines: Column) -> Column:
    """The kind of each line: heading, list, text, table or empty; `table!` where a table opens.

    A pipe table opens where its separator line comes next and lasts as long as its lines; an HTML table lasts to the
    line that closes it. One fold over the lines, as what a line is depends on what is open.
    """
    pairs = F.transform(F.transform(lines, T.strip), lambda x, i: F.struct(x.alias("x"), T.strip(F.get(lines, i + 1)).alias("next")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("kinds"))

    def step(s: Column, p: Column) -> Column:
        x = p["x"]
        barred = x.startswith("|") & F.substring(x, F.lit(2), F.length(x)).contains("|")
        closes = F.lower(x).contains("</table")
        html, pipe = F.lit("html"), F.lit("pipe")
        kind = (
            F.when(s["open"] == html, "table").when(x == "", "").when((s["open"] == pipe) & barred, "table").when(x.rlike(BLOCK_HEADING), "heading")
            .when(x.rlike(BLOCK_HTML), "table!").when(barred & F.coalesce(p["next"].rlike(BLOCK_SEPARATOR), F.lit(False)), "table!")
            .when(x.rlike(BLOCK_LIST), "list").otherwise("text")
        )
        still = (
            F.when(s["open"] == html, F.when(closes, "").otherwise(html)).when((s["open"] == pipe) & barred, pipe).when(x.rlike(BLOCK_HEADING), "")
            .when(x.rlike(BLOCK_HTML), F.when(closes, "").otherwise(html)).when(barred & F.coalesce(p["next"].rlike(BLOCK_SEPARATOR), F.lit(False)), pipe).otherwise("")
        )
        return F.struct(still.alias("open"), F.concat(s["kinds"], F.array(kind)).alias("kinds"))

    return F.aggregate(pairs, start, step, lambda s: s["kinds"])


def text_blocks(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_idx, type, text): headings alone, pipe and HTML tables, lists and other text.

    Empty lines part blocks and belong to none. Runs of lines of one kind are found inside the row, without a shuffle.
    """
    kinds = with_lines(df, key, text_col).withColumn("kinds", line_kinds(F.col("lines")))
    at = lambda i: F.get("kinds", i)
    goes_on = (lambda i: (F.rtrim(at(i), F.lit("!")) == F.rtrim(at(i - 1), F.lit("!"))) & ~at(i).isin("heading", "table!"))
    spots = F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)))
    marked = kinds.withColumn("starts", F.filter(spots, lambda i: ~F.coalesce(goes_on(i), F.lit(False))))
    runs = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.rtrim(at(s), F.lit("!")).alias("type"),
            T.strip(F.array_join(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), "\n")).alias("text"),
        ),
    )
    kept = F.filter(runs, lambda r: F.coalesce(r["type"] != "", F.lit(False)))
    return each(marked, ["doc_id"], kept).select("doc_id", F.col("pos").alias("block_idx"), "col.type", "col.text")


def split_long_text(text: Column, most: int = MOST_TOKENS) -> Column:
    """Pieces of a text: whole up to `most` estimated tokens, else filled with paragraphs in order, those beyond it with
    sentences; a sentence is never cut."""
    tokens = T.estimate_tokens
    paragraphs = F.split(text, "\n{2,}")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(tokens(p) > most, F.split(p, r"(?<=[.!?。！？])(?U:\s)+")).otherwise(F.array(p))))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(s: Column, u: Column) -> Column:
        full = (F.size(s["open"]) > 0) & (s["n"] + tokens(u) > most)
        return F.when(
            full, F.struct(F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n"))).alias("done"), F.array(u).alias("open"), tokens(u).alias("n"))
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(u)).alias("open"), (s["n"] + tokens(u)).alias("n")))

    folded = F.aggregate(units, state, add, lambda s: F.concat(s["done"], F.filter(F.array(F.array_join(s["open"], "\n\n")), lambda x: F.size(s["open"]) > 0)))
    pieces = F.when(tokens(text) <= most, F.array(text)).otherwise(folded)
    return F.filter(pieces, lambda p: T.strip(p) != "")


def table_told(html: Column, caption: Column, footnote: Column) -> Column:
    """A table block as text: its caption, its first row as columns, its other rows, its footnote. Rows and cells are those
    of the HTML; a text without any is given as it is. Captions and footnotes are lists of texts, joined by spaces."""
    joined = lambda texts: T.strip(F.array_join(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull()), " "))
    every = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    cells = F.transform(every(html, "tr"), lambda row: F.transform(every(row, "t[dh]"), lambda c: T.clean_chunk_text(F.regexp_replace(c, "<[^>]+>", ""))))
    rows = F.filter(cells, lambda row: F.exists(row, lambda c: c != ""))
    named = F.transform(rows, lambda row, i: F.concat(F.when(i == 0, F.lit("Columns: ")).otherwise(F.concat(F.lit("Row "), i.cast("string"), F.lit(": "))), F.array_join(row, " | ")))
    body = T.bind(named, lambda n: F.when(F.size(n) > 0, n).otherwise(F.array(T.strip(html))))
    parts = F.concat(F.array(F.concat(F.lit("Table: "), F.nullif(joined(caption), F.lit("")))), body, F.array(F.concat(F.lit("Note: "), F.nullif(joined(footnote), F.lit("")))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def figure_told(text: Column, caption: Column, image: Column) -> Column:
    """A figure block as text: its own, or its caption, or that there is an image; empty without any of them."""
    named = T.strip(F.array_join(F.filter(F.coalesce(caption, F.array().cast("array<string>")), lambda x: x.isNotNull()), " "))
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(named, F.lit("")), F.when(F.coalesce(image, F.lit("")) != "", "Figure image"), F.lit(""))


def told_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_ord, type, text, page_idx, table_caption, table_footnote, img_path) with the text of tables
    and figures as table_told and figure_told give it; other blocks stay."""
    text = T.strip(F.coalesce("text", F.lit("")))
    kind = _content_type(F.coalesce("type", F.lit("unknown")))
    told = F.when(kind == "table", table_told(text, F.col("table_caption"), F.col("table_footnote"))).when(kind == "figure", figure_told(text, F.col("table_caption"), F.col("img_path"))).otherwise(F.col("text"))
    return blocks.withColumn("text", told)


def chunks_of(blocks: DataFrame, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents: from their blocks where they have any, else from their texts; the columns of text_chunks."""
    columns = ["doc_id", "seq", "chunk_id", "page_no", "content_type", "section_title", "chunk_text"]
    bare = df.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")).join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    return block_chunks(blocks).select(columns).unionByName(text_chunks(bare).select(columns))


def section_pages(df: DataFrame, blocks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section_no, page_no): the page of the first block with a page that holds a section's title or the first 80
    characters of its text; null where none does.

    Sections and blocks meet by document, by an equi-join; blocks carry their text, sections their two snippets.
    """
    own = sections(df, key, text_col).select("doc_id", "section_no", T.inline_text(F.col("title")).alias("title"), F.substring(T.inline_text(F.col("text")), 1, 80).alias("lead"))
    paged = blocks.where("page_idx is not null").select("doc_id", "block_ord", "page_idx", T.inline_text(F.coalesce("text", F.lit(""))).alias("body"))
    fits = lambda c: ~F.col(c).isin("", "document") & F.col("body").contains(F.col(c))
    found = own.join(paged, "doc_id").where(fits("title") | fits("lead")).groupBy("doc_id", "section_no").agg((F.min_by("page_idx", "block_ord") + 1).alias("page_no"))
    return own.select("doc_id", "section_no").join(found, ["doc_id", "section_no"], "left")


def _content_type(kind: Column) -> Column:
    out = F.lit("unsupported")
    for name, kinds in CONTENT_TYPES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def classified_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_ord, type, text, page_idx) with page_no, body, is_heading, section_title, content_type and
    reason: why a block gives no chunk, null if it does."""
    low = lambda title: title.rlike(LOW_VALUE_SECTION)
    kind = F.coalesce("type", F.lit("unknown"))
    rows = blocks.select("doc_id", "block_ord", kind.alias("type"), T.strip(F.coalesce("text", F.lit(""))).alias("body"), (F.coalesce("page_idx", F.lit(0)) + 1).alias("page_no"))
    noise = F.col("type").isin(*NOISE_TYPES)
    heading = ~noise & (F.col("type").isin(*HEADING_TYPES) | (F.col("body").rlike(r"^#{1,6}(?U:\s)+\S+") & ~F.col("body").contains("\n")))
    title = T.collapse(F.regexp_replace(F.col("body"), r"^#{1,6}(?U:\s)+", ""))
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit("document"))
    so_far = Window.partitionBy("doc_id").orderBy("block_ord")
    rows = rows.withColumn("is_heading", heading).withColumn("content_type", _content_type(F.col("type")))
    rows = rows.withColumn("section_title", F.coalesce(F.last(F.when(F.col("is_heading"), title), True).over(so_far), F.lit("document")))
    empty = F.col("body") == ""
    reason = (
        F.when(noise, "noise")
        .when(F.col("is_heading"), F.when(low(F.col("section_title")), "low_value_section").otherwise("heading"))
        .when(low(F.col("section_title")), "inside_low_value_section")
        .when(F.col("content_type") == "unsupported", "unsupported")
        .when(empty & (F.col("content_type") == "text"), "empty_text")
        .when(empty & (F.col("content_type") == "table"), "empty_table")
        .when(empty & (F.col("content_type") == "figure"), "weak_figure")
        .when(empty, "empty_formula")
    )
    return rows.withColumn("reason", reason)


def block_chunks(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, chunk_id, page_no, pages, content_type, section_title, chunk_text) of blocks (doc_id, block_ord,
    type, text, page_idx).

    Text runs on over blocks of one page and section until it reaches FLUSH_TOKENS; other blocks stand alone. Noise
    neither gives nor parts chunks. Hard breaks are found by windows on doc_id, so that the fold over a run, which looks
    at the length after every block, sees one page of one section at a time.
    """
    rows = classified_blocks(blocks).where("reason is null or reason in ('heading', 'low_value_section')")
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    text = (F.col("content_type") == "text") & ~F.col("is_heading")
    alone = ~text
    before = F.lag(F.struct(alone.alias("alone"), "page_no")).over(order)
    breaks = alone | before.isNull() | before["alone"] | (before["page_no"] != F.col("page_no"))
    runs = rows.withColumn("run", F.sum(breaks.cast("int")).over(order)).where("reason is null")
    held = runs.groupBy("doc_id", "run", "content_type", "page_no", "section_title").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "body"))), lambda b: b["body"]).alias("bodies"))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, b: Column) -> Column:
        joined = F.when(s["open"] == "", b).otherwise(F.concat_ws("\n", s["open"], b))
        return F.when(T.estimate_tokens(joined) >= FLUSH_TOKENS, F.struct(F.concat(s["done"], F.array(joined)).alias("done"), F.lit("").alias("open"))).otherwise(
            F.struct(s["done"].alias("done"), joined.alias("open"))
        )

    merged = F.filter(F.aggregate("bodies", state, add, lambda s: F.concat(s["done"], F.array(s["open"]))), lambda x: x != "")
    whole = F.when(F.col("content_type") == "text", merged).otherwise(F.col("bodies"))
    long = F.col("content_type").isin("text", "table")
    pieces = F.flatten(F.transform(F.transform(whole, T.clean_chunk_text), lambda x: F.when(long, split_long_text(x)).otherwise(F.array(x))))
    flat = each(held, ["doc_id", "run", "content_type", "page_no", "section_title"], pieces, "part", "piece")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "part"))
    named = flat.withColumn("seq", seq)
    chunk_id = F.concat_ws(":", T.slug(F.col("doc_id").cast("string")), F.concat(F.lit("p"), F.col("page_no").cast("string")), "content_type", F.col("seq").cast("string"))
    return named.select("doc_id", "seq", chunk_id.alias("chunk_id"), "page_no", F.array("page_no").alias("pages"), "content_type", "section_title", T.clean_chunk_text(F.col("piece")).alias("chunk_text"))


def table_text(headers: Column, body: Column) -> Column:
    rows = F.transform(body, lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ")))
    head = F.when(F.size(headers) > 0, F.array(F.concat(F.lit("Columns: "), F.array_join(headers, " | ")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, rows), "\n")


def text_chunks(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, chunk_id, page_no, content_type, section_title, chunk_text) of texts without blocks: the pieces of
    each section that isn't of low value, then each pipe table as text."""
    own = sections(df, key, text_col).withColumn("section_title", F.coalesce(F.nullif(T.collapse(F.col("title")), F.lit("")), F.lit("document")))
    own = own.where(~F.col("section_title").rlike(LOW_VALUE_SECTION))
    clean = own.withColumn("clean", T.clean_chunk_text(F.col("text")))
    parts = each(clean, ["doc_id", F.lit(0).alias("rank"), F.col("section_no").alias("at"), "section_title"], split_long_text(F.col("clean")), "part", "chunk_text")
    told = T.clean_chunk_text(table_text(F.col("headers"), F.col("body")))
    keep = ["doc_id", F.lit(1).alias("rank"), F.col("table_index").alias("at"), F.lit("document").alias("section_title")]
    both = parts.unionByName(each(tables(df, key, text_col), keep, F.filter(F.array(told), lambda x: x != ""), "part", "chunk_text"))
    kind = F.when(F.col("rank") == 0, "text").otherwise("table")
    numbered = both.select("doc_id", kind.alias("content_type"), "section_title", "chunk_text", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "at", "part")).alias("seq"))
    chunk_id = F.concat_ws(":", T.slug(F.col("doc_id").cast("string")), F.lit("p1"), "content_type", F.col("seq").cast("string"))
    return numbered.select("doc_id", "seq", chunk_id.alias("chunk_id"), F.lit(1).alias("page_no"), "content_type", "section_title", "chunk_text")
