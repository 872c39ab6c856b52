"""Queries of search, reports, memory, profiles and synthetic table sheets, with oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.rows import each
from docmill.operators import evaluation, facts, nested, search, tables
from docmill.plans import profiles, reports, view
from docmill.queries import REGISTRY
from docmill.queries.core import LINES, SPACE, TABLE_MODEL, TABLES, WS, documents_of
from docmill.queries.problems import CALL_ROWS, SCORE_ROWS, STEP_ROWS
from docmill.session import table
from docmill.sources import html

query = REGISTRY.query


@query(
    "chunk_search",
    f"""
    with q as (select row_id as query_id, file_key, lower(trim(regexp_replace(coalesce(section_title, ''), '{SPACE}+', ' ', 'g'), {WS})) as needle from retrieval_chunks where row_id % 100 = 0),
    qt as (select *, list_distinct(list_filter(regexp_split_to_array(replace(needle, '|', ' '), '{SPACE}+'), lambda w: w <> '')) as asked from q),
    c as (select row_id as chunk_ord, file_key, lower(trim(regexp_replace(coalesce(chunk_text, ''), '{SPACE}+', ' ', 'g'), {WS})) as hay from retrieval_chunks),
    ct as (select *, list_distinct(list_filter(regexp_split_to_array(replace(hay, '|', ' '), '{SPACE}+'), lambda w: w <> '')) as held from c),
    met as (select query_id, chunk_ord, len(list_intersect(asked, held)) + case when contains(hay, needle) then 100 else 0 end as score from qt join ct using (file_key)),
    ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_ord) as rank from met)
    select query_id, chunk_ord, cast(score as integer) as score, cast(rank as integer) as rank from ranked where rank <= 3
    """,
)
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_chunks")
    asked = rows.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("file_key").alias("scope"), F.col("section_title").alias("query"))
    return search.lexical_top_k(asked, rows.select(F.col("file_key").alias("scope"), F.col("row_id").alias("chunk_ord"), F.col("chunk_text").alias("text"))).drop("holds_query")


@query(
    "embedding_cosine",
    """
    with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0),
    met as (select query_id, vec_id, round(list_cosine_similarity(cast(q as double[]), cast(embedding as double[])), 6) as cosine from q join embeddings on query_id <> vec_id),
    ranked as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from met)
    select query_id, vec_id, cosine, cast(rank as integer) as rank from ranked where rank <= 5
    """,
)
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search.nearest_vectors(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows)


@query(
    "event_load_report",
    """
    select event_type, count(*) as n, round(count_if(value > 10) * 1.0 / count(*), 6) as success_rate, min(value) as min_s, round(quantile_cont(value, 0.5), 6) as p50_s,
      round(quantile_cont(value, 0.95), 6) as p95_s, max(value) as max_s,
      concat_ws(',', case when round(count_if(value > 10) * 1.0 / count(*), 6) < 0.9 then 'success_rate' end, case when round(quantile_cont(value, 0.95), 6) > 100 then 'p95' end) as failures
    from events group by event_type
    """,
)
def event_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.load_report(table(spark, sf_dir, "events"), F.col("value") > 10, "value", ["event_type"])
    return reports.threshold_failures(report, 0.9, 100)


@query("event_state", "select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.current_state(table(spark, sf_dir, "events"), "user_id", "event_type", F.struct("ts", "event_id"))


@query("event_props", "select event_id, json_extract_string(props, '$.k') as k from events where json_valid(props)")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("event_id", T.parse_object(F.col("props")).alias("v")).where("v is not null")
    return held.select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"))


@query(
    "event_repeats",
    """
    select event_id, coalesce(lag(event_type) over w = event_type and lag(event_type, 2) over w = event_type, false) as repeated,
      coalesce(bool_or(event_type = 'purchase') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as open
    from events window w as (partition by user_id order by ts, event_id)
    """,
)
def event_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = reports.repeated_tool(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return reports.gated(turns, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "repeated", "open")


OUTCOMES = """
    outcomes as (
      select event_type as profile, event_id as id, ['initial', 'text_cleanup', 'ocr_retry', 'cli_fallback'][event_id % 4 + 1] as action,
        case when value > 50 then 'pass' else 'needs_review' end as status, cast(floor(value) as integer) as score, ['code_' || (event_id % 3)] as issue_codes from events
    )"""


@query(
    "memory_stats",
    f"""
    with {OUTCOMES}, recent as (select *, row_number() over (partition by profile order by id desc) as no from outcomes),
    stats as (
      select profile, action, count(*) as attempts, count_if(status = 'pass' and action <> 'initial') as successes,
        round(count_if(status = 'pass' and action <> 'initial') / count(*), 4) as success_rate, round(avg(score), 2) as avg_score
      from recent where no <= 200 and list_has_any(issue_codes, ['code_0', 'code_1']) group by all
    ), ranked as (select *, row_number() over (partition by profile order by success_rate desc, successes desc, avg_score desc, action) as rank from stats)
    select profile, action, attempts, cast(successes as bigint) as successes, success_rate, avg_score, cast(rank as integer) as rank,
      action <> 'initial' and successes > 0 and count_if(action <> 'initial' and successes > 0) over (partition by profile order by rank) <= 3 as recommended from ranked
    """,
)
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.array(*[F.lit(a) for a in ("initial", "text_cleanup", "ocr_retry", "cli_fallback")])
    outcomes = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("profile"), F.col("event_id").alias("id"), F.get(actions, (F.col("event_id") % 4).cast("int")).alias("action"),
        F.when(F.col("value") > 50, "pass").otherwise("needs_review").alias("status"), F.floor("value").cast("int").alias("score"),
        F.array(F.concat(F.lit("code_"), (F.col("event_id") % 3).cast("string"))).alias("issue_codes"),
    )
    return reports.memory_stats(outcomes, ["code_0", "code_1"])


@query(
    "long_document_report",
    """
    select case_id, count(*) as ranges, count_if(status = 'completed')::bigint as completed, count_if(status = 'failed')::bigint as failed,
      round(count_if(status = 'completed') / count(*), 4) as success_rate, cast(coalesce(sum(retrieval_chunks), 0) as bigint) as chunks, round(sum(elapsed_seconds), 3) as seconds
    from long_document_risk_report group by case_id
    """,
)
def long_document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_document_report(table(spark, sf_dir, "long_document_risk_report"))


@query("risk_issue_histogram", "select code, count(*) as n from (select unnest(issue_codes) as code from long_document_risk_report) group by code")
def risk_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_histogram(table(spark, sf_dir, "long_document_risk_report"))


@query(
    "risk_histograms",
    """
    select 'status' as field, status as value, count(*) as n from long_document_risk_report group by all
    union all select 'quality_status', quality_status, count(*) from long_document_risk_report group by all
    union all select 'provenance_level', provenance_level, count(*) from long_document_risk_report group by all
    """,
)
def risk_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "long_document_risk_report").select("status", "quality_status", "provenance_level")
    return rows.unpivot([], ["status", "quality_status", "provenance_level"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


@query(
    "page_ranges",
    """
    with s as (select file_key, page_count, unnest(generate_series(1, page_count, 20)) as first from source_files where page_count > 0)
    select file_key, cast(first as integer) as first_page, cast(least(first + 19, page_count) as integer) as last_page,
      'p' || lpad(first::varchar, 3, '0') || '_' || lpad(least(first + 19, page_count)::varchar, 3, '0') as range_name from s
    """,
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").where("page_count > 0")
    first = files.select("file_key", "page_count", F.explode_outer(F.sequence(F.lit(1), F.col("page_count"), F.lit(20))).alias("first_page"))
    last = F.least(F.col("first_page") + 19, F.col("page_count"))
    name = F.concat(F.lit("p"), F.lpad(F.col("first_page").cast("string"), 3, "0"), F.lit("_"), F.lpad(last.cast("string"), 3, "0"))
    return first.select("file_key", "first_page", last.alias("last_page"), name.alias("range_name"))


@query(
    "chunk_validation",
    f"""
    with c as (select file_key, cast(chunk_id is null as int) + cast(page_no is null as int) + cast(section_title is null as int) as missing, length(coalesce(chunk_text, '')) as chars,
      nullif(lower(trim(regexp_replace(coalesce(chunk_text, ''), '{SPACE}+', ' ', 'g'), {WS})), '') as norm from retrieval_chunks)
    select file_key, count(*) as chunks, cast(sum(missing) as bigint) as missing_fields, count_if(norm is null)::bigint as empty_texts, count(norm) - count(distinct norm) as duplicates,
      cast(min(chars) as integer) as min_chars, round(sum(chars) / count(*), 4) as avg_chars, cast(max(chars) as integer) as max_chars from c group by file_key
    """,
)
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_validation(table(spark, sf_dir, "retrieval_chunks"), "file_key", "chunk_text", ("chunk_id", "page_no", "section_title"))


@query(
    "trace_status",
    f"""
    with s as (select record_id, count(*) as steps, count_if(status = 'failed') as failed, count_if(status = 'completed') as done from ({STEP_ROWS}) group by record_id)
    select trace_id as record_id, coalesce(steps, 0) as steps, cast(coalesce(failed, 0) as bigint) as failed,
      coalesce(nullif(status, ''), case when failed > 0 then 'failed_inferred' when steps > 0 and done = steps then 'completed_inferred' else 'unknown' end) as status
    from trace left join s on trace_id = record_id
    """,
)
def trace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = table(spark, sf_dir, "trace")
    return reports.run_status(trace, nested.trace_steps(trace), "trace_id", "status")


@query(
    "trace_tools",
    f"""
    select tool, count(*) as calls, cast(count_if(status = 'failed') as bigint) as failed, round(sum(elapsed_seconds), 3) as total_seconds, round(max(elapsed_seconds), 3) as max_seconds
    from ({CALL_ROWS}) group by tool
    """,
)
def trace_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tool_report(nested.tool_calls(table(spark, sf_dir, "trace")))


@query(
    "report_score_deltas",
    f"""
    with s as (select record_id || '#' || parent as pair, field, n from ({SCORE_ROWS}) where n is not null)
    select a.pair, a.n as baseline_value, b.n as other_value, b.n - a.n as delta
    from s a left join s b on a.pair = b.pair and b.field = 'llm.quality_score' where a.field = 'baseline.quality_score'
    """,
)
def report_score_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = nested.report_scores(table(spark, sf_dir, "llm_impact_report")).select(F.concat_ws("#", "record_id", "parent").alias("pair"), "field", "n")
    return reports.pair_deltas(scores, "pair", "field", "baseline.quality_score", "llm.quality_score", "n")


@query(
    "label_evaluation",
    """
    with p as (select label = 'page' as expected, length(coalesce(text, '')) >= 200 as predicted, lang from review_labels join documents on doc_id = row_id where tbl = 'documents'),
    c as (select lang, count(*) as n, count_if(expected) as expected, count_if(predicted) as predicted, count_if(expected and predicted) as matched, count_if(expected = predicted) as agreed from p group by lang),
    r as (select *, case when predicted = 0 then 1.0 else matched / predicted end as pr, case when expected = 0 then 1.0 else matched / expected end as re from c)
    select lang, n, expected::bigint as expected, predicted::bigint as predicted, matched::bigint as matched, round(agreed / n, 6) as accuracy, round(pr, 6) as precision, round(re, 6) as recall,
      round(case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end, 6) as f1 from r
    """,
)
def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule held against the reviewed labels, by language."""
    labels = table(spark, sf_dir, "review_labels").where("tbl = 'documents'").select(F.col("row_id").alias("doc_id"), (F.col("label") == "page").alias("expected"))
    docs = documents_of(spark, sf_dir).select("doc_id", "lang", (F.length(F.coalesce("text", F.lit(""))) >= 200).alias("predicted"))
    return reports.evaluation(labels.join(docs, "doc_id"), ["lang"])


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks as the section titles of the chunks, each distinct one once."""
    titles = table(spark, sf_dir, "retrieval_chunks").where("section_title is not null").select("section_title").distinct()
    return titles.select(F.md5("section_title").alias("task_id"), F.col("section_title").alias("task"))


PROFILE_ROWS = ", ".join(f"({i}, '{name}', '{' '.join((name, about, *words)).lower()}', {list(words)})" for i, (name, (about, words)) in enumerate(profiles.PROFILES.items()))


def profile_tokens_sql(low: str) -> str:
    """Words, ideographs and pairs of neighbouring ideographs of a lower-case text."""
    chars = f"regexp_extract_all({low}, '[一-鿿]')"
    return f"list_concat(list_concat(regexp_extract_all({low}, '[a-z0-9]+'), {chars}), list_transform(range(1, greatest(len({chars}), 1)), lambda i: {chars}[i] || {chars}[i + 1]))"


@query(
    "profile_scores",
    f"""
    with p as (select * from (values {PROFILE_ROWS}) as t(no, profile, about, words)),
    t as (select distinct md5(section_title) as task_id, lower(section_title) as low from retrieval_chunks where section_title is not null),
    tt as (select task_id, token, count(*) as n from (select task_id, unnest({profile_tokens_sql("low")}) as token from t) group by all),
    pt as (select no, token, count(*) as m from (select no, unnest({profile_tokens_sql("about")}) as token from p) group by all),
    dots as (select task_id, no, sum(n * m) as dot from tt join pt using (token) group by all),
    tn as (select task_id, sqrt(sum(n * n)) as tn from tt group by all), pn as (select no, sqrt(sum(m * m)) as pn from pt group by all),
    base as (select task_id, no, profile, len(list_filter(words, lambda w: contains(low, lower(w)))) as hits, len(words) as of from t, p),
    scored as (
      select task_id, profile, no, hits, coalesce(dot / (tn * pn), 0.0) as cosine, 0.68 * hits / greatest(of, 1) + 0.32 * coalesce(dot / (tn * pn), 0.0) as score
      from base left join dots using (task_id, no) left join tn using (task_id) left join pn using (no)
    )
    select task_id, profile, cast(hits as integer) as hits, round(cosine, 4) as cosine, round(score, 4) as score,
      cast(row_number() over (partition by task_id order by round(score, 9) desc, profile = 'general_document', no) as integer) as rank from scored
    """,
)
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_scores(tasks_of(spark, sf_dir))


INTENT_SQL = " union all ".join(
    f"select task_id, '{name}' as intent from t where {' or '.join(f'''contains(low, '{w}')''' for w in words)}" for name, words in profiles.INTENTS.items() if name != "comparison"
)


@query(
    "task_intents",
    f"""
    with t as (select distinct md5(section_title) as task_id, lower(section_title) as low from retrieval_chunks where section_title is not null),
    own as ({INTENT_SQL} union all select task_id, 'comparison' from t where {" or ".join(f"contains(low, '{w}')" for w in profiles.INTENTS["comparison"])}),
    more as (select * from own union select a.task_id, 'comparison' from own a join own b using (task_id) where a.intent = 'ranking' and b.intent = 'growth_analysis')
    select * from more union all select task_id, 'structured_extraction' from t where task_id not in (select task_id from own)
    """,
)
def task_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.intents(tasks_of(spark, sf_dir))


ORDER_ROWS = """
    items as (
      select l_orderkey, l_linenumber, l_quantity, cast(l_extendedprice as decimal(18,2)) as amount,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as no,
        lag(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as before
      from lineitem
    )"""


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table for each order: line (blank where it repeats), quantity and amount, and a total row that is right for
    even keys and one too much for odd ones."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.row_number().over(order).alias("no"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), "l_quantity",
        F.when(F.lag("l_linenumber").over(order) == F.col("l_linenumber"), "").otherwise(F.col("l_linenumber").cast("string")).alias("line"),
    )
    row = F.concat(F.lit("| "), "line", F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), F.col("amount").cast("string"), F.lit(" |"))
    rows = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", row.alias("row")))), lambda r: r["row"]).alias("rows"), F.sum("amount").alias("total"))
    total = F.concat(F.lit("| total | n/a | "), (F.col("total") + F.col("l_orderkey") % 2).cast("decimal(18,2)").cast("string"), F.lit(" |"))
    head = F.array(F.lit("| line | qty | amount |"), F.lit("| --- | --- | --- |"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.array_join(F.concat(head, "rows", F.array(total)), "\n").alias("text"))


@query(
    "order_total_checks",
    f"""
    with {ORDER_ROWS}, sums as (select l_orderkey, count(*) as n, sum(amount) as s from items group by l_orderkey)
    select l_orderkey as doc_id, case when n < 2 then 'numeric_total_needs_review' when l_orderkey % 2 = 0 then 'numeric_total_verified' else 'numeric_total_mismatch' end as code,
      case when n >= 2 and l_orderkey % 2 = 0 then 'info' else 'warning' end as level
    from sums
    """,
)
def order_total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.tables(order_sheets(spark, sf_dir))
    return tables.total_issues(tables.total_checks(found)).select("doc_id", "code", "level")


@query(
    "order_filled_cells",
    f"""
    with {ORDER_ROWS}
    select l_orderkey as doc_id, cast(no as integer) as row_index, 0 as column_index, cast(l_linenumber as varchar) as value from items where before = l_linenumber
    """,
)
def order_filled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merged_cells(tables.tables(order_sheets(spark, sf_dir))).select("doc_id", "row_index", "column_index", "value")


@query(
    "order_comparisons",
    f"""
    with {ORDER_ROWS}
    select l_orderkey as doc_id, cast(no - 1 as integer) as row_index, l_quantity as current_value, cast(amount as double) as baseline_value, round(l_quantity - cast(amount as double), 4) as delta
    from items where no <= 100
    """,
)
def order_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.comparisons(tables.tables(order_sheets(spark, sf_dir))).select("doc_id", "row_index", "current_value", "baseline_value", "delta")


COMPARED = rf"""
    valued as (
      select doc_id, table_index, row_index, column_index, value,
        try_cast(replace(regexp_extract(value, '[-+]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?'), ',', '') as double) as number from body
    ), sides as (
      select doc_id, table_index, row_index, max(value) filter (where column_index = 0) as label, list(number order by column_index) filter (where column_index > 0 and number is not null) as numbers
      from valued group by all having count(*) >= 3
    ), compared as (
      select doc_id, cast(table_index as integer) as table_index, cast(row_index as integer) as row_index, label, numbers[1] as current_value, numbers[2] as baseline_value,
        round(numbers[1] - numbers[2], 4) as delta, case when numbers[2] <> 0 then round((numbers[1] - numbers[2]) / numbers[2] * 100, 4) end as percent_change
      from sides where len(numbers) >= 2
    ), firsts as (select * from (select *, row_number() over (partition by doc_id order by table_index, row_index) as no from compared) where no <= 100)"""


@query("doc_comparisons", f"with {LINES}, {TABLES}, {TABLE_MODEL}, {COMPARED} select * exclude (no) from firsts")
def doc_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.comparisons(tables.tables(documents_of(spark, sf_dir)))


@query(
    "doc_top_growth",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {COMPARED}
    select doc_id, label, percent_change from (select *, row_number() over (partition by doc_id order by percent_change desc, table_index, row_index) as best from firsts where percent_change is not null) where best = 1
    """,
)
def doc_top_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_growth(profiles.comparisons(tables.tables(documents_of(spark, sf_dir))))


@query("chunk_html_tables")
def chunk_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_tables(table(spark, sf_dir, "retrieval_chunks").where("chunk_text is not null"), "row_id", "chunk_text")


@query("doc_html_blocks")
def doc_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.read_html_blocks(documents_of(spark, sf_dir), "doc_id", "text")


@query("doc_html_links")
def doc_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_links(documents_of(spark, sf_dir), "doc_id", "text")


@query(
    "title_numbers",
    r"""
    with n as (select row_id, coalesce(chunk_text, '') as body, unnest(regexp_extract_all(section_title, '[-+]?[0-9][0-9,，]*(?:\.[0-9]+)?%?')) as number from retrieval_chunks)
    select row_id, number from n where not contains(body, number) and not contains(replace(replace(body, ',', ''), '，', ''), replace(replace(number, ',', ''), '，', ''))
    """,
)
def title_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a chunk's title that its text doesn't hold."""
    rows = table(spark, sf_dir, "retrieval_chunks")
    return each(rows, ["row_id"], evaluation.unsupported_numbers(F.col("section_title"), F.col("chunk_text")), "at", "number").drop("at")


@query("label_numeric_evidence")
def label_numeric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each labelled page, whether its first date's year stands among the figures of a line."""
    docs = documents_of(spark, sf_dir).join(table(spark, sf_dir, "review_labels").where("tbl = 'documents'").select(F.col("row_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    wanted = facts.dates(docs).select("doc_id", F.col("date_no").alias("check_no"), F.col("date").alias("text_contains"), F.lit(None).cast("array<string>").alias("numbers"))
    return evaluation.numeric_evidence(wanted, facts.numeric_facts(docs))


@query("doc_equations")
def doc_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.equations(documents_of(spark, sf_dir).where(F.col("text").contains("=")), "doc_id", "text")


@query("doc_view")
def doc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full view of every document, its parts as counts and their JSON as a hash."""
    found = view.full_view(documents_of(spark, sf_dir))
    parts = ("sections", "tables", "key_values", "numeric_facts", "dates", "anomaly_lines", "recommendations", "references")
    sizes = [F.coalesce(F.size(p), F.lit(0)).alias(f"n_{p}") for p in parts]
    return found.select("doc_id", *sizes, "heading_count", "fallback_count", F.md5(F.to_json(F.struct(*parts))).alias("view_md5"))


@query(
    "chunk_stats",
    """
    with c as (select file_key, coalesce(content_type, 'unknown') as type, case when len(pages) > 0 then pages else [page_no] end as pages from retrieval_chunks),
    t as (select file_key, type, count(*) as n from c group by all),
    p as (select file_key, count(distinct page) as pages from (select file_key, unnest(pages) as page from c) group by file_key)
    select t.file_key, cast(sum(n) as bigint) as total_chunks, string_agg(type || '=' || n, ',' order by type) as types, coalesce(any_value(p.pages), 0) as pages
    from t left join p on t.file_key is not distinct from p.file_key group by t.file_key
    """,
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_stats(table(spark, sf_dir, "retrieval_chunks"), "file_key")


@query(
    "risk_status_counts",
    """
    select provenance_level, count(*) as total, count_if(status = 'completed')::bigint as completed, count_if(status = 'failed')::bigint as failed,
      count_if(coalesce(status not in ('completed', 'failed'), true))::bigint as other from long_document_risk_report group by provenance_level
    """,
)
def risk_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(table(spark, sf_dir, "long_document_risk_report"), ["provenance_level"], "status", ("completed", "failed"))


@query(
    "risk_groups",
    """
    with g as (select case when starts_with(file_key, 'a') then 'first' when starts_with(file_key, 'b') then 'second' when starts_with(file_key, 'f_00') then 'files' else 'other' end as "group",
      quality_score, elapsed_seconds from long_document_risk_report)
    select coalesce("group", 'other') as "group", count(*) as n, round(avg(quality_score), 2) as avg_score, round(coalesce(sum(elapsed_seconds), 0), 3) as total_seconds, round(avg(elapsed_seconds), 3) as avg_seconds
    from g group by all
    """,
)
def risk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.prefix_groups(table(spark, sf_dir, "long_document_risk_report"), "file_key", [("a", "first"), ("b", "second"), ("f_00", "files")])
    return reports.group_summary(rows, "quality_score", "elapsed_seconds")


@query("trace_leaf_text")
def trace_leaf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of all leaf texts of each payload."""
    return nested.leaf_texts(table(spark, sf_dir, "trace"), "trace_id", "payload").select("trace_id", F.length("leaf_text").alias("leaf_chars"))
