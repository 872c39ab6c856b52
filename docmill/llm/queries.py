"""Queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from docmill.llm import bpe, lookalike, mojibake, nearduplicates, packing, prose, splitting, stuffing
from docmill.registry import Registry
from docmill.session import table

REGISTRY = Registry()
query = REGISTRY.query


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def two_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id, text) of the layout blocks and of the chunks."""
    blocks = table(spark, sf_dir, "complex_financial_report_content_list")
    chunks = table(spark, sf_dir, "retrieval_chunks")
    blocks = blocks.select(F.lit("complex_financial_report_content_list").alias("tbl"), F.col("block_id").alias("id"), "text")
    return blocks.unionByName(chunks.select(F.lit("retrieval_chunks").alias("tbl"), F.col("row_id").alias("id"), F.col("chunk_text").alias("text")))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(two_text_tables(spark, sf_dir), ["tbl", "id"], "text")


@query("p2_canonical")
def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(two_text_tables(spark, sf_dir), ["tbl", "id"], "text")


def garbled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = mojibake.garbled_texts(table(spark, sf_dir, "complex_financial_report_content_list"), ["block_id"], "text")
    chunks = mojibake.garbled_texts(table(spark, sf_dir, "retrieval_chunks"), ["row_id"], "chunk_text")
    blocks = blocks.withColumn("tbl", F.lit("complex_financial_report_content_list")).withColumnRenamed("block_id", "id")
    return blocks.unionByName(chunks.withColumn("tbl", F.lit("retrieval_chunks")).withColumnRenamed("row_id", "id"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_rows(spark, sf_dir).select("tbl", "id")


@query("p3_repaired")
def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_rows(spark, sf_dir).select("tbl", "id", "repaired", F.array_join("undone", " > ").alias("undone"), "lost")


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "retrieval_chunks").withColumn("blank", F.coalesce(~F.col("chunk_text").rlike(r"\S"), F.lit(True)))
    stats = prose.quality_stats(chunks, "row_id", "chunk_text", "content_type", "blank")
    return stats.where("tail and not blank and content_type = 'text'").select("row_id")


@query("p6_stats")
def p6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.quality_stats(table(spark, sf_dir, "retrieval_chunks"), "row_id", "chunk_text", "content_type")


NAMED_PAGES = r"""
    named as (
      select range_id, unnest(regexp_extract_all(page_range, '[0-9]+(?:\s*(?:[-–—~]|\.\.|to)\s*p?[0-9]+)?')) as part
      from long_document_risk_report
    ), spans as (
      select range_id, cast(regexp_extract_all(part, '[0-9]+')[1] as bigint) as a, cast(regexp_extract_all(part, '[0-9]+')[-1] as bigint) as b from named
    ), covered as (
      select distinct range_id, unnest(generate_series(least(a, b), greatest(a, b))) as page from spans
    )"""


@query(
    "p5_found",
    f"""
    with {NAMED_PAGES}
    select 'retrieval_chunks' as tbl, row_id as id from retrieval_chunks where length(chunk_text) > 3600
    union all
    select 'long_document_risk_report', range_id from covered group by range_id having count(*) > 20
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, sf_dir, "retrieval_chunks"), "row_id", "chunk_text").where("piece = 0")
    ranges = splitting.split_ranges(table(spark, sf_dir, "long_document_risk_report"), "range_id", "page_range").where("piece = 0")
    pieces = pieces.select(F.lit("retrieval_chunks").alias("tbl"), F.col("row_id").alias("id"))
    return pieces.unionByName(ranges.select(F.lit("long_document_risk_report").alias("tbl"), F.col("range_id").alias("id")))


@query("p5_pieces")
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "retrieval_chunks"), "row_id", "chunk_text", "pages")


@query(
    "p5_ranges",
    f"""
    with {NAMED_PAGES}, islands as (
      select range_id, page, page - row_number() over (partition by range_id order by page) as island from covered
    ), joined as (
      select range_id, min(page) as first, max(page) as last, count(*) as n from islands group by range_id, island
    ), long as (
      select range_id, sum(n) as pages from joined group by range_id having sum(n) > 20
    ), cut as (
      select range_id, cast(pages as bigint) as pages, unnest(generate_series(first, greatest(first, last - 1), 19)) as first_page, last
      from joined join long using (range_id)
    )
    select range_id, pages, cast(row_number() over (partition by range_id order by first_page) - 1 as integer) as piece,
      first_page, least(first_page + 19, last) as last_page
    from cut
    """,
)
def p5_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_ranges(table(spark, sf_dir, "long_document_risk_report"), "range_id", "page_range")


def near_duplicates(spark: SparkSession, sf_dir: str) -> nearduplicates.NearDuplicates:
    return nearduplicates.NearDuplicates(table(spark, sf_dir, "retrieval_chunks"), "row_id", "section_title", "chunk_text")


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).pairs().select("id_a", "id_b")


@query("p4_groups")
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).groups()


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.page_spam(table(spark, sf_dir, "documents"), "doc_id").where("spam").select("doc_id")


@query("p9_evidence")
def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.page_spam(table(spark, sf_dir, "documents"), "doc_id")
