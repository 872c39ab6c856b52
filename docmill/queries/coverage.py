"""Queries of coverage, rules over blocks, set operations, schema checks, search over parts, and block texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.patterns import ANOMALY_WORDS, DATE, ENTITY_WORDS, RECOMMENDATION_WORDS
from docmill.operators import blocks, evaluation, facts, keyvalues, nested, quality, search, setops
from docmill.plans import reports
from docmill.queries import REGISTRY
from docmill.queries.core import (
    BESIDE, HEADINGS, KEY_VALUES, LINES, NUMERAL, SPACE, TABLE_MODEL, TABLES, WS, documents_of, inline_sql, layout_blocks,
)
from docmill.queries.problems import STEP_ROWS
from docmill.session import table

query = REGISTRY.query


@query(
    "doc_field_coverage",
    f"""
    select doc_id, regexp_matches(coalesce(text, ''), '{DATE}') as has_date, regexp_matches(lower(coalesce(text, '')), '{"|".join(RECOMMENDATION_WORDS)}') as has_recommendation,
      regexp_matches(lower(coalesce(text, '')), '{"|".join(ANOMALY_WORDS)}') as has_anomaly_signal from documents
    """,
)
def doc_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.field_coverage(documents_of(spark, sf_dir))


@query(
    "party_entities",
    """
    select row_id as doc_id, kv_index, key, value from retrieval_chunks,
      lateral (values (0, '甲方', file_key), (1, 'Issuer Company', run_id), (3, 'third party', 'Party ' || row_id)) as v(kv_index, key, value) where coalesce(value, '') <> ''
    """,
)
def party_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity candidates of a sheet made for each chunk, of a line with a full-width colon, a list line and a table."""
    rows = table(spark, sf_dir, "retrieval_chunks")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(
        F.lit("# Parties\n\n甲方："), some("file_key"), F.lit("\n- Issuer Company: "), some("run_id"), F.lit("\nAmount: "), F.col("row_id").cast("string"),
        F.lit("\n| field | value |\n| --- | --- |\n| third party | Party "), F.col("row_id").cast("string"), F.lit(" |"),
    )
    return keyvalues.entity_candidates(keyvalues.key_values(rows.select(F.col("row_id").alias("doc_id"), text.alias("text"))))


def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of each file in a run: its blocks' texts in order, one below the other."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return layout_blocks(spark, sf_dir).groupBy("doc_id").agg(text.alias("text"))


RUN_TEXTS = """
    block_rows as (select concat_ws('/', file_key, run_id) as doc_id, file_key, block_id, page_idx, coalesce(text, '') as text from complex_financial_report_content_list),
    run_texts as (select doc_id, any_value(file_key) as file_key, string_agg(text, chr(10) order by block_id) as text, count(*) as items, count(distinct page_idx) as pages from block_rows group by doc_id)"""


@query(
    "block_issues",
    f"""
    with {RUN_TEXTS}, d as (
      select t.*, coalesce(suffix in ('.html', '.docx', '.pptx'), false) as native, coalesce(suffix in ('.html', '.docx'), false) as page_free, coalesce(profile = 'general', false) as general,
        trim(t.text, {WS}) as bare, len(regexp_extract_all(t.text, '�|锟斤拷|Ã.|Â.')) as bad
      from run_texts t left join source_files using (file_key)
    ), hits as (
      select doc_id, unnest([
        case when bare = '' then ('empty_markdown', 'error') end,
        case when bare <> '' and bad > 0 then ('possible_mojibake', case when bad / greatest(length(text), 1) > 0.02 then 'error' else 'warning' end) end,
        case when bare <> '' and length(text) < 200 and not (native and pages = 0 and (general or length(bare) >= 80)) then ('short_text', 'warning') end,
        case when pages = 0 and page_free then ('document_level_provenance', 'info') end,
        case when pages = 0 and not page_free then ('no_page_provenance', 'warning') end,
        case when pages = 1 and items > 30 then ('weak_page_provenance', 'warning') end
      ]) as hit from d
    ) select doc_id, hit[1] as code, hit[2] as level from hits where hit is not null
    """,
)
def block_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and page rules of every file in a run. Files that come without pages are judged as native ones."""
    summary = blocks.content_summary(layout_blocks(spark, sf_dir)).select("doc_id", "item_count", "page_count")
    files = table(spark, sf_dir, "source_files").select("file_key", "suffix", "profile")
    docs = run_texts(spark, sf_dir).join(summary, "doc_id").withColumn("file_key", F.substring_index("doc_id", "/", 1)).join(files, "file_key", "left")
    level = F.col("page_count") == 0
    native = level & F.col("suffix").isin(".html", ".docx", ".pptx")
    rules = quality.text_rules(F.col("text"), native, F.col("profile") == "general")
    return quality.issues(docs, *rules, *quality.page_rules(F.col("item_count"), F.col("page_count"), F.coalesce(F.col("suffix").isin(".html", ".docx"), F.lit(False))))


TOLD = r"""
    cut as (
      select block_id, trim(coalesce(text, ''), {ws}) as html, trim(array_to_string(table_caption, ' '), {ws}) as caption, trim(array_to_string(table_footnote, ' '), {ws}) as note,
        list_transform(regexp_extract_all(coalesce(text, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1),
          lambda c: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {ws}))) as cells
      from complex_financial_report_content_list where type = 'table'
    ), kept as (select *, list_filter(cells, lambda r: len(list_filter(r, lambda c: c <> '')) > 0) as rows from cut)""".format(ws=WS)


@query(
    "block_tables",
    f"""
    with {TOLD}
    select block_id, array_to_string(list_filter(list_concat([case when caption <> '' then 'Table: ' || caption end],
      list_concat(case when len(rows) > 0 then list_transform(rows, lambda r, i: case when i = 1 then 'Columns: ' else 'Row ' || (i - 1) || ': ' end || array_to_string(r, ' | ')) else [html] end,
      [case when note <> '' then 'Note: ' || note end])), lambda x: x <> ''), chr(10)) as told
    from kept
    """,
)
def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table blocks told as text, with captions and footnotes."""
    rows = table(spark, sf_dir, "complex_financial_report_content_list").where("type = 'table'")
    text = F.trim(F.coalesce("text", F.lit("")))
    return rows.select("block_id", blocks.table_told(text, F.col("table_caption"), F.col("table_footnote")).alias("told"))


@query(
    "block_figures",
    f"""
    select block_id, coalesce(nullif(trim(coalesce(text, ''), {WS}), ''), nullif(trim(array_to_string(table_caption, ' '), {WS}), ''), case when coalesce(img_path, '') <> '' then 'Figure image' end, '') as told, img_path
    from complex_financial_report_content_list where type in ('image', 'figure')
    """,
)
def block_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure blocks told as text, with the path of their image."""
    rows = table(spark, sf_dir, "complex_financial_report_content_list").where("type in ('image', 'figure')")
    as_blocks = rows.withColumns({"doc_id": F.lit(""), "block_ord": F.col("block_id")})
    return blocks.told_blocks(as_blocks).select("block_id", F.col("text").alias("told"), "img_path")


@query("layout_chunks")
def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every registered file in a run from its blocks, tables and figures told with their captions; of the
    chunks' own files that no block names, from the texts."""
    rows = table(spark, sf_dir, "complex_financial_report_content_list")
    named = rows.withColumns({"doc_id": F.concat_ws("/", "file_key", "run_id"), "block_ord": F.col("block_id")})
    return blocks.chunks_of(blocks.told_blocks(named), documents_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


RUN_LINES = LINES.replace("from documents)", "from run_texts)")


@query(
    "section_pages",
    f"""
    with {RUN_TEXTS}, {RUN_LINES}, {HEADINGS}, bodies as (
      select doc_id, section_no, trim(coalesce(string_agg(line, chr(10) order by line_no) filter (where level = 0), ''), {WS}) as text from numbered where section_no > 0 group by all
    ), own as (
      select n.doc_id, n.section_no, {inline_sql("title")} as title, substr({inline_sql("b.text")}, 1, 80) as lead from numbered n join bodies b on n.doc_id = b.doc_id and n.section_no = b.section_no where level > 0
      union all select doc_id, 1, 'document', substr({inline_sql(f"trim(text, {WS})")}, 1, 80) from run_texts where trim(text, {WS}) <> '' and doc_id not in (select doc_id from marks where level > 0)
    ), paged as (select doc_id, block_id, page_idx, {inline_sql("text")} as body from block_rows where page_idx is not null),
    hits as (
      select o.doc_id, section_no, arg_min(page_idx, block_id) + 1 as page_no from own o join paged p on o.doc_id = p.doc_id
        and (title not in ('', 'document') and contains(body, title) or lead not in ('', 'document') and contains(body, lead)) group by all
    ) select o.doc_id, cast(o.section_no as integer) as section_no, cast(page_no as integer) as page_no from own o left join hits h on o.doc_id = h.doc_id and o.section_no = h.section_no
    """,
)
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.section_pages(run_texts(spark, sf_dir), layout_blocks(spark, sf_dir))


@query(
    "doc_evidence_map",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES}, stood as (
      select kv.doc_id, kv_index, min(line_no) as line_no from kv join lines l on kv.doc_id = l.doc_id and contains(line, key) and contains(line, value) group by all
    )
    select kv.doc_id, key, string_agg(value || '@' || coalesce(cast(s.line_no as varchar), ''), ' | ' order by kv.kv_index) as evidence
    from kv left join stood s on kv.doc_id = s.doc_id and kv.kv_index = s.kv_index group by all
    """,
)
def doc_evidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence map, each entry as its value and line."""
    docs = documents_of(spark, sf_dir)
    found = keyvalues.evidence_map(keyvalues.field_evidence(keyvalues.key_values(docs), docs))
    told = F.transform("evidence", lambda e: F.concat(e["value"], F.lit("@"), F.coalesce(e["line_no"].cast("string"), F.lit(""))))
    return found.select("doc_id", "key", F.array_join(told, " | ").alias("evidence"))


@query(
    "keyword_hits",
    f"""
    with {LINES}, {HEADINGS}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES}, bodies as (
      select doc_id, section_no, trim(coalesce(string_agg(line, chr(10) order by line_no) filter (where level = 0), ''), {WS}) as text from numbered where section_no > 0 group by all
    ), told_sections as (
      select n.doc_id, n.section_no - 1 as ord, title || ' | ' || b.text as text from numbered n join bodies b on n.doc_id = b.doc_id and n.section_no = b.section_no where level > 0
      union all select doc_id, 0, 'document | ' || trim(text, {WS}) from documents where trim(coalesce(text, ''), {WS}) <> '' and doc_id not in (select doc_id from marks where level > 0)
    ), told_tables as (
      select doc_id, table_index as ord, string_agg(row, ' | ' order by row_index) as text from (
        select doc_id, table_index, -1 as row_index, string_agg(head, ' | ' order by col) as row from heads group by all
        union all select doc_id, table_index, row_index, string_agg(value, ' | ' order by column_index) from body group by all) group by all
    ), clean as (
      select doc_id, line_no, {inline_sql("regexp_replace(line, '<[^>]+>', ' ', 'g')")} as text from lines where regexp_matches(line, '[0-9]')
    ), told_facts as (
      select doc_id, line_no as ord, substr(text, 1, 300) as text from clean where regexp_matches(text, '(?:^|{BESIDE}){NUMERAL}(?:{BESIDE}|$)')
    ), every as (
      select *, 0 as kind_rank, 'section' as kind, 200 as most from told_sections union all select *, 1, 'table', 50 from told_tables
      union all select doc_id, kv_index, key || ' | ' || value, 2, 'key_value', 200 from kv union all select *, 3, 'numeric_fact', 200 from told_facts
    ), capped as (select * from (select *, row_number() over (partition by doc_id, kind_rank order by ord) as no from every) where no <= most),
    hits as (select *, row_number() over (partition by doc_id order by kind_rank, ord) as hit_no from capped where contains(lower(text), 'audit'))
    select h.doc_id, cast(hit_no as integer) as hit_no, kind, cast(ord as bigint) as ord, h.text, len(string_split(lower(coalesce(d.text, '')), 'audit')) - 1 as raw_count
    from hits h join documents d using (doc_id) where hit_no <= 5
    """,
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five parts of each document that hold a word, and how often its text does."""
    docs = documents_of(spark, sf_dir)
    hits = search.keyword_search(search.search_sources(docs), "audit")
    return hits.join(search.raw_counts(docs, "audit").withColumnRenamed("n", "raw_count"), "doc_id").withColumn("ord", F.col("ord").cast("bigint"))


@query(
    "search_hit_rates",
    f"""
    with q as (select row_id as query_id, file_key, lower(trim(regexp_replace(coalesce(section_title, ''), '{SPACE}+', ' ', 'g'), {WS})) as needle from retrieval_chunks where row_id % 100 = 0),
    qt as (select *, list_distinct(list_filter(regexp_split_to_array(replace(needle, '|', ' '), '{SPACE}+'), lambda w: w <> '')) as asked from q),
    c as (select row_id as chunk_ord, file_key, lower(trim(regexp_replace(coalesce(chunk_text, ''), '{SPACE}+', ' ', 'g'), {WS})) as hay from retrieval_chunks),
    ct as (select *, list_distinct(list_filter(regexp_split_to_array(replace(hay, '|', ' '), '{SPACE}+'), lambda w: w <> '')) as held from c),
    met as (select query_id, chunk_ord, contains(hay, needle) as holds, len(list_intersect(asked, held)) + case when contains(hay, needle) then 100 else 0 end as score from qt join ct using (file_key)),
    ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_ord) as rank from met),
    flags as (select query_id, bool_or(holds) as hit from ranked where rank <= 3 group by query_id)
    select file_key, count(*) as queries, cast(count_if(hit) as bigint) as hits, round(count_if(hit) / count(*), 6) as hit_rate from q left join flags using (query_id) group by file_key
    """,
)
def search_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_chunks")
    asked = rows.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("file_key").alias("scope"), F.col("section_title").alias("query"))
    chunks = rows.select(F.col("file_key").alias("scope"), F.col("row_id").alias("chunk_ord"), F.col("chunk_text").alias("text"))
    return search.hit_rates(search.lexical_top_k(asked, chunks), asked, "scope").withColumnRenamed("scope", "file_key")


@query(
    "chunk_schema_errors",
    """
    with e as (select unnest([case when chunk_id is null then 'missing:chunk_id' end, case when page_no is null then 'missing:page_no' end, case when pages is null then 'missing:pages' end,
      case when content_type is null then 'missing:content_type' end, case when section_title is null then 'missing:section_title' end, case when chunk_text is null then 'missing:chunk_text' end,
      case when image_path is null then 'missing:image_path' end, case when page_no is not null and row_id % 7 = 0 then 'page_no_not_int' end, case when row_id % 11 = 0 then 'pages_not_list' end]) as error,
      row_id, pages from retrieval_chunks where row_id % 13 <> 0)
    select error, count(*) as n from e where error is not null and not (error = 'missing:pages' and row_id % 11 = 0) group by error
    union all select 'chunk is not an object', count(*) from retrieval_chunks where row_id % 13 = 0
    """,
)
def chunk_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the chunks as JSON, into which wrong kinds were put: every 7th page is text, every 11th list of pages is a
    number, every 13th chunk is a list."""
    rows = table(spark, sf_dir, "retrieval_chunks")
    every = lambda n: F.col("row_id") % n == 0
    page = F.when(every(7), F.to_json(F.struct(F.col("page_no").cast("string").alias("page_no")))).otherwise(F.to_json(F.struct("page_no")))
    pages = F.when(every(11), F.to_json(F.struct(F.lit(1).alias("pages")))).otherwise(F.to_json(F.struct("pages")))
    rest = F.to_json(F.struct("chunk_id", "content_type", "section_title", "chunk_text", "image_path"))
    inside = F.transform(F.array(page, pages, rest), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
    whole = F.concat(F.lit("{"), F.array_join(F.filter(inside, lambda x: x != ""), ","), F.lit("}"))
    kept = rows.select("row_id", F.when(every(13), F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole).alias("chunk"))
    return reports.chunk_errors(kept, "row_id", "chunk").groupBy("error").agg(F.count("*").alias("n"))


@query(
    "label_checks",
    """
    with c as (
      select 'page' as kind, label = 'page' as expected, length(coalesce(text, '')) >= 200 as passed from review_labels join documents on doc_id = row_id where tbl = 'documents'
      union all select 'not_page', label <> 'page', length(coalesce(text, '')) < 200 from review_labels join documents on doc_id = row_id where tbl = 'documents'
      union all select 'prose', label = 'prose', r.content_type = 'text' from review_labels l join retrieval_chunks r on r.row_id = l.row_id where tbl = 'retrieval_chunks'
    ), k as (select kind, count_if(expected) as expected, count_if(expected and passed) as matched from c group by kind union all select '*', count_if(expected), count_if(expected and passed) from c)
    select kind, cast(expected as bigint) as expected, cast(matched as bigint) as matched, cast(expected - matched as bigint) as failed, round(case when expected = 0 then 1.0 else matched / expected end, 6) as rate from k
    """,
)
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rules held against the reviewed labels, by kind of check and over all."""
    labels = table(spark, sf_dir, "review_labels")
    pages = labels.where("tbl = 'documents'").select(F.col("row_id").alias("doc_id"), "label").join(documents_of(spark, sf_dir).select("doc_id", "text"), "doc_id")
    long = F.length(F.coalesce("text", F.lit(""))) >= 200
    chunks = labels.where("tbl = 'retrieval_chunks'").select("row_id", "label").join(table(spark, sf_dir, "retrieval_chunks").select("row_id", "content_type"), "row_id")
    check = lambda kind, expected, passed: [F.lit(kind).alias("kind"), expected.alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed")]
    checks = pages.select(check("page", F.col("label") == "page", long)).unionByName(pages.select(check("not_page", F.col("label") != "page", ~long)))
    return reports.check_summary(checks.unionByName(chunks.select(check("prose", F.col("label") == "prose", F.col("content_type") == "text"))))


@query("uncovered_files", "select file_key, filename from source_files where file_key not in (select file_key from long_document_risk_report where file_key is not null)")
def uncovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select("file_key", "filename")
    return setops.uncovered(files, table(spark, sf_dir, "long_document_risk_report"), "file_key")


@query(
    "unhandled_codes",
    """
    with f as (select case_id, coalesce(quality_status = 'pass', false) as handled, unnest(issue_codes) as code from long_document_risk_report)
    select case_id, code from f where code is not null group by case_id, code having not bool_or(handled)
    """,
)
def unhandled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue codes of a case that none of its ranges of status `pass` has."""
    return setops.unhandled_codes(table(spark, sf_dir, "long_document_risk_report"), "case_id", "issue_codes", F.col("quality_status") == "pass")


@query(
    "merged_plans",
    f"""
    with s as (select record_id, list(trim(name) order by step_no) as steps from ({STEP_ROWS}) where name is not null group by record_id),
    p as (select trace_id, s.steps, lag(s.steps) over (partition by file_key order by trace_id) as base from trace left join s on record_id = trace_id)
    select trace_id, array_to_string(list_concat(coalesce(base, []), list_transform(list_filter(coalesce(steps, []), lambda x: x <> '' and not list_contains(coalesce(base, []), x)), lambda x: 'then: ' || x)), ' > ') as plan from p
    """,
)
def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of the trace before, of the same file, with the fresh ones of each trace."""
    trace = table(spark, sf_dir, "trace")
    named = nested.trace_steps(trace).where("name is not null").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", F.trim("name").alias("name")))), lambda s: s["name"]).alias("steps"))
    joined = trace.select("trace_id", "file_key").join(named.withColumnRenamed("record_id", "trace_id"), "trace_id", "left")
    base = F.lag("steps").over(Window.partitionBy("file_key").orderBy("trace_id"))
    return joined.withColumn("base", base).select("trace_id", F.array_join(setops.merged_steps(F.col("base"), F.col("steps"), "then: "), " > ").alias("plan"))


@query(
    "deduped_steps",
    f"""
    with s as (select record_id, name, list(coalesce(status, '') order by step_no) as found from ({STEP_ROWS}) where coalesce(name, '') <> '' group by all)
    select record_id, name, found[1] as source, array_to_string(found[2:], ',') as further_sources from s
    """,
)
def deduped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step name of a trace once, with the status it first had and those of its repeats."""
    rows = nested.trace_steps(table(spark, sf_dir, "trace")).withColumn("status", F.coalesce("status", F.lit("")))
    return setops.deduped_actions(rows, ["record_id"], "name", "step_no", "status").withColumn("further_sources", F.array_join("further_sources", ","))


@query(
    "chunk_runs",
    """
    with r as (select run_id, min(trace_id) as a from trace where run_id is not null group by all), f as (select file_key, min(trace_id) as b from trace where file_key is not null group by all)
    select row_id, coalesce(a, b) as trace_id, case when a is not null then 'run_id' when b is not null then 'file_key' end as matched_by from retrieval_chunks left join r using (run_id) left join f using (file_key)
    """,
)
def chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.matched_runs(table(spark, sf_dir, "retrieval_chunks"), table(spark, sf_dir, "trace"), "row_id", "run_id", "file_key", "trace_id")


@query(
    "order_references",
    """
    select doc_id, source_title, source_line, reference_text, target_page, target_hint, relation, cast(confidence as double) as confidence from (
      select o_orderkey as doc_id, 'Order ' || o_orderkey as source_title, 1 as source_line, o_orderkey % 40 as p from orders), lateral (values
        (1, '参见第' || p || '页', p, null, 'page_reference', case when p = 0 then 0.56 else 0.78 end), (2, '详见附件B', null, 'B', 'attachment_reference', 0.56), (3, '同上文', null, '上文', 'context_reference', 0.56),
        (4, '见 下表', null, '下表', 'table_reference', 0.56)) as v(no, reference_text, target_page, target_hint, relation, confidence)
    """,
)
def order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a sheet made for each order."""
    rows = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"), F.lit("\n金额参见第"), (F.col("o_orderkey") % 40).cast("string"), F.lit("页，条款详见附件B；\n其余同上文，见 下表。"))
    return facts.references(rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@query(
    "order_equations",
    """
    with s as (select o_orderkey as doc_id, o_custkey % 90 + 10 as a, o_orderkey % 80 + 10 as b, o_orderkey % 2 as off from orders)
    select doc_id, 0 as eq_no, ' ' || a || ' + ' || b || ' = ' || (a + b + off) as expression, cast(a + b as double) as computed, cast(a + b + off as double) as reported, off = 0 as balanced,
      case when off = 1 then 'incorrect_arithmetic_match_claim' end as code from s
    """,
)
def order_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums written in a sheet made for each order, right for even keys, all said to match."""
    rows = table(spark, sf_dir, "orders")
    a, b = F.col("o_custkey") % 90 + 10, F.col("o_orderkey") % 80 + 10
    text = F.concat(F.lit("Total: "), a.cast("string"), F.lit(" + "), b.cast("string"), F.lit(" = "), (a + b + F.col("o_orderkey") % 2).cast("string"), F.lit(" as figures match"))
    return evaluation.equations(rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), "doc_id", "text")


@query(
    "order_numeric_evidence",
    """
    with s as (select o_orderkey as doc_id, o_custkey % 900 + 100 as a, o_orderkey % 90 + 10 as b from orders)
    select doc_id, 0 as check_no, true as matched, 3 as line_no from s union all select doc_id, 1, false, null from s union all select doc_id, 2, true, 2 from s
    """,
)
def order_numeric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers looked for in a sheet made for each order: both in one line, two of different lines, and one with no text."""
    rows = table(spark, sf_dir, "orders")
    a, b = (F.col("o_custkey") % 900 + 100).cast("string"), (F.col("o_orderkey") % 90 + 10).cast("string")
    docs = rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order\nqty 7 is open\nThe Sum of "), a, F.lit(" and "), b, F.lit(" holds")).alias("text"))
    check = lambda no, text, *numbers: F.struct(F.lit(no).alias("check_no"), F.lit(text).cast("string").alias("text_contains"), F.array(*numbers).alias("numbers"))
    wanted = F.inline(F.array(check(0, "sum OF", a, b), check(1, "sum of", a, F.lit("7")), check(2, None, F.lit("7"))))
    return evaluation.numeric_evidence(rows.select(F.col("o_orderkey").alias("doc_id"), wanted), facts.numeric_facts(docs))
