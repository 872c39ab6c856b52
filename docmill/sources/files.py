"""Readers of saved artifacts and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.rows import each

#: Suffixes that are read natively, and all that an upload may have; bytes an upload may hold.
NATIVE = ("html", "htm", "docx", "pptx")
ALLOWED = (*NATIVE, "pdf", "png", "jpg", "jpeg", "md", "txt")
MOST_BYTES = 200 * 1024 * 1024


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8, with U+FFFD for what isn't."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_content_list(df: DataFrame, key: str = "doc_id", json_col: str = "content_list") -> DataFrame:
    """(doc_id, page_idx, block_idx, block VARIANT, error) of JSON content lists, flat or nested by page.

    A nested list's place is the page and the block of what names none itself; what isn't an object gives an error row;
    what isn't a list gives none.
    """
    items = F.from_json(F.col(json_col), "array<string>")
    bare = F.trim(F.col(json_col))
    top = each(df.where(bare.startswith("[")), [F.col(key).alias("doc_id")], items, "item_idx", "item")
    nested = F.trim("item").startswith("[")
    inner = F.when(nested, F.from_json("item", "array<string>")).otherwise(F.array("item"))
    flat = each(top, ["doc_id", "item_idx", nested.alias("nested")], inner, "inner_idx", "raw")
    block = F.when(F.trim("raw").startswith("{"), F.try_parse_json("raw"))
    page = F.coalesce(F.try_variant_get(block, "$.page_idx", "int"), F.when(F.col("nested"), F.col("item_idx")))
    spot = F.coalesce(F.try_variant_get(block, "$.block_idx", "int"), F.when(F.col("nested"), F.col("inner_idx")).otherwise(F.col("item_idx")))
    error = F.when(block.isNull(), F.when(F.col("nested"), "non-dict block in page").otherwise("unsupported content item"))
    return flat.select("doc_id", page.alias("page_idx"), spot.alias("block_idx"), block.alias("block"), error.alias("error"))


def block_text(block: F.Column) -> F.Column:
    """The text of an open block: its text, or its content if that is text, or the parts of its content."""
    own = F.nullif(F.try_variant_get(block, "$.text", "string"), F.lit(""))
    content = F.when(F.schema_of_variant(F.try_variant_get(block, "$.content", "variant")) == "STRING", F.try_variant_get(block, "$.content", "string"))
    names = ("paragraph_content", "list_items", "title_content", "page_footnote_content", "image_caption", "image_footnote", "table_caption", "table_footnote")
    parts = [F.transform(F.try_variant_get(block, f"$.content.{n}", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.content", "string"), F.try_variant_get(v, "$", "string"))) for n in names]
    none = F.array().cast("array<string>")
    joined = F.array_join(F.filter(F.flatten(F.array(*[F.coalesce(p, none) for p in parts])), lambda x: F.coalesce(x != "", F.lit(False))), "\n")
    return F.coalesce(own, content, joined, F.lit(""))


def admitted(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (path, length) with suffix, native and reject: why an input isn't taken, null if it is."""
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    reject = F.when(~suffix.isin(*ALLOWED), "unsupported suffix").when(F.col("length") == 0, "empty file").when(F.col("length") > most_bytes, "too large")
    return files.withColumns({"suffix": suffix, "native": suffix.isin(*NATIVE), "reject": reject})


def pdf_page_count(content: F.Column) -> F.Column:
    """Page objects named in the raw bytes of a PDF."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page\b"))


def batch_tasks(manifest: DataFrame, caller: dict[str, str] | None = None) -> DataFrame:
    """(task_no, id, input, task, profile) of a manifest row (defaults MAP, tasks ARRAY<MAP>): what an item says holds
    before what the caller says, that before the manifest's defaults, those before the built-in ones."""
    built_in = {"profile": "general_document", "task": ""}
    items = each(manifest, ["defaults"], "tasks", "task_no", "item")
    pick = lambda n: F.coalesce(F.try_element_at("item", F.lit(n)), F.lit((caller or {}).get(n)), F.try_element_at("defaults", F.lit(n)), F.lit(built_in.get(n)))
    return items.select("task_no", *[pick(n).alias(n) for n in ("id", "input", "task", "profile")])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, in as many files as df has partitions."""
    df.write.mode("overwrite").json(path)


def append_outcomes(df: DataFrame, path: str) -> None:
    """Append recovery outcomes to a table partitioned by profile, so that reading one profile prunes the others."""
    df.write.mode("append").partitionBy("profile").parquet(path)


def write_results(df: DataFrame, path: str, by: str = "run_id") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)
