"""Search over chunks and vectors: stated queries against all rows, the best k of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.rows import each
from docmill.operators.documents import sections
from docmill.operators.facts import numeric_facts
from docmill.operators.keyvalues import key_values
from docmill.operators.tables import tables


#: Parts that the chunks of a scope are split into.
SALTS = 16


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_ord, score, holds_query, rank) of queries (query_id, scope, query) against chunks (scope, chunk_ord, text).

    The score is the number of distinct words shared, and 100 more if the whole query stands in the text. Only chunks of
    the query's scope meet it, by an equi-join that splits a scope's chunks over SALTS tasks, as one scope may hold a third of
    all; ranks are cut before the final shuffle. Ties go by chunk_ord. Null texts
    share no word; an empty query stands in every text.
    """
    parts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    q = queries.select("query_id", "scope", T.normalized(F.coalesce("query", F.lit(""))).alias("needle"), F.explode(parts).alias("salt")).withColumn("asked", T.lexical_tokens(F.col("needle")))
    c = chunks.select("scope", "chunk_ord", F.pmod(F.xxhash64("chunk_ord"), F.lit(SALTS)).cast("int").alias("salt"), T.normalized(F.coalesce("text", F.lit(""))).alias("hay"))
    c = c.withColumn("held", T.lexical_tokens(F.col("hay")))
    score = F.size(F.array_intersect("asked", "held")) + F.when(F.col("hay").contains(F.col("needle")), 100).otherwise(0)
    whole = F.col("hay").contains(F.col("needle"))
    met = q.join(c, ["scope", "salt"]).select("query_id", "chunk_ord", score.alias("score"), whole.alias("holds_query"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_ord"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hit_rates(found: DataFrame, queries: DataFrame, by: str) -> DataFrame:
    """by, queries, hits, hit_rate of queries (query_id, by) whose best chunks were found by lexical_top_k: a hit is a
    query that stands whole in one of them. Queries without any chunk are misses."""
    hit = found.groupBy("query_id").agg(F.bool_or("holds_query").alias("hit"))
    flags = queries.select("query_id", by).join(hit, "query_id", "left")
    return flags.groupBy(by).agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 6).alias("hit_rate"))


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int = 5, blocks: int = 8, parts: int | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k rows of (vec_id, vector) nearest each of (query_id, vector), itself aside.

    Exact: the stated queries against all rows, in blocks. Queries are dealt into `blocks` and rows into `parts` (by
    default the session's shuffle partitions); a task holds one block against one part, so their number grows with the
    cluster, and a row is copied `blocks` times, a query, of which there are few, `parts` times.
    """
    unit = lambda v: F.sqrt(_dot(v, v))
    parts = parts or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    q = queries.select("query_id", F.col("vector").alias("q"), unit(F.col("vector")).alias("qn"), dealt("query_id", blocks).alias("block"))
    q = each(q, ["query_id", "q", "qn", "block"], every(parts), "at", "part")
    r = rows.select("vec_id", F.col("vector").alias("r"), unit(F.col("vector")).alias("rn"), dealt("vec_id", parts).alias("part"))
    r = each(r, ["vec_id", "r", "rn", "part"], every(blocks), "at", "block")
    met = q.join(r, ["block", "part"]).where("query_id <> vec_id and qn > 0 and rn > 0")
    scored = met.select("query_id", "vec_id", F.round(_dot(F.col("q"), F.col("r")) / (F.col("qn") * F.col("rn")), 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Parts of a document that a keyword search goes through: sections, tables, key-values and facts, and how many of each.
SEARCHED = {"section": 200, "table": 50, "key_value": 200, "numeric_fact": 200}


def search_sources(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind_rank, kind, ord, text) of what a keyword search of a document goes through, in its order: titles and
    texts of sections, cells of tables, key-values, lines with numbers; the first SEARCHED of each kind."""
    bar = F.lit(" | ")
    cells = F.concat(F.array(F.array_join("headers", " | ")), F.transform("body", lambda r: F.array_join(r, " | ")))
    parts = {
        "section": sections(df, key, text_col).select("doc_id", (F.col("section_no") - 1).alias("ord"), F.concat("title", bar, "text").alias("text")),
        "table": tables(df, key, text_col).select("doc_id", F.col("table_index").alias("ord"), F.array_join(cells, " | ").alias("text")),
        "key_value": key_values(df, key, text_col).select("doc_id", F.col("kv_index").alias("ord"), F.concat("key", bar, "value").alias("text")),
        "numeric_fact": numeric_facts(df, key, text_col).select("doc_id", F.col("line_no").alias("ord"), "text"),
    }
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    kinds = [
        rows.withColumn("no", nth).where(F.col("no") <= SEARCHED[kind]).select("doc_id", F.lit(i).alias("kind_rank"), F.lit(kind).alias("kind"), "ord", "text")
        for i, (kind, rows) in enumerate(parts.items())
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


def raw_counts(df: DataFrame, keyword: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): how often the keyword stands in a text, in any case."""
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    gone = F.length(low) - F.length(F.replace(low, F.lit(keyword.lower()), F.lit("")))
    return df.select(F.col(key).alias("doc_id"), (gone / len(keyword)).cast("bigint").alias("n"))


def keyword_search(sources: DataFrame, keyword: str, limit: int = 5) -> DataFrame:
    """(doc_id, hit_no, kind, ord, text): rows of (doc_id, kind_rank, kind, ord, text) that hold the keyword in any case,
    the first `limit` of each document by kind and place."""
    hits = sources.where(F.lower("text").contains(keyword.lower()))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind_rank", "ord"))
    return hits.withColumn("hit_no", no).where(F.col("hit_no") <= limit).select("doc_id", "hit_no", "kind", "ord", "text")
