"""Queries of the text and table operators over documents, with oracle statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import KEY_HEADERS, RECOMMENDATION_WORDS, VALUE_HEADERS
from docmill.functions.rows import each
from docmill.operators import blocks, documents, facts, keyvalues, quality, tables
from docmill.queries import REGISTRY
from docmill.session import table

query = REGISTRY.query

# Pieces of SQL: white space as strip() takes it, lines of a text, and what is made of them.
WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LINES = f"""
    split as (select doc_id, regexp_split_to_array(coalesce(text, ''), '{BREAK}') as parts from documents),
    docs as (select doc_id, case when parts[-1] = '' then parts[:-2] else parts end as lines from split),
    lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as line_no from docs)"""
HEADINGS = rf"""
    marks as (
      select doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}}){SPACE}+(.+?){SPACE}*$', 1)) as level,
        trim(regexp_extract(line, '^(#{{1,6}}){SPACE}+(.+?){SPACE}*$', 2), {WS}) as title, line
      from lines
    ), numbered as (
      select *, count(*) filter (where level > 0) over (partition by doc_id order by line_no rows unbounded preceding) as section_no from marks
    )"""
TABLES = rf"""
    flagged as (select doc_id, line_no, line, line_no - row_number() over (partition by doc_id order by line_no) as island
      from lines where regexp_matches(line, '^{SPACE}*\|(.+)\|{SPACE}*$')),
    found as (select doc_id, island, min(line_no) as start_line from flagged group by all having count(*) >= 2),
    indexed as (select *, row_number() over (partition by doc_id order by start_line) - 1 as table_index from found),
    cut as (
      select i.doc_id, table_index, start_line, line_no, list_transform(string_split(trim(trim(line, {WS}), '|'), '|'), lambda x: trim(x, {WS})) as cells
      from flagged join indexed i using (doc_id, island)
    ),
    kept as (
      select *, row_number() over (partition by doc_id, table_index order by line_no) - 1 as row_no from cut
      where len(list_filter(cells, lambda x: not regexp_matches(x, '^[-: ]*$'))) > 0
    )"""
# A number that no letter, digit, dot, slash, hyphen or date sign stands beside; without look-around, by what may stand there.
NUMERAL = r"[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?%?"
BESIDE = "[^0-9A-Za-z./年月日-]"
HAS_NUMBER = f"(?:^|{BESIDE}){NUMERAL}(?:{BESIDE}|$)"


def inline_sql(x: str) -> str:
    """Entities decoded and white space collapsed, as inline_text does."""
    for name, code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("#39", 39), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), {WS})"


def cell_number_sql(x: str) -> str:
    """A cell as a number, as cell_number takes it."""
    clean = f"trim(replace({x}, ',', ''), {WS})"
    negative = f"(starts_with({clean}, '(') and ends_with({clean}, ')'))"
    bare = f"case when {negative} then trim(substr({clean}, 2, length({clean}) - 2), {WS}) else {clean} end"
    bare = f"trim(regexp_replace(regexp_replace({bare}, '^[￥¥$]', ''), '(?:人民币|元|万元|亿元|万|亿)$', ''), {WS})"
    return f"""case when regexp_matches({x}, '[0-9]') and not contains({x}, '%') and regexp_matches({bare}, '^[-+]?[0-9]+(?:\\.[0-9]+)?$')
      then case when {negative} then -cast({bare} as double) else cast({bare} as double) end end"""


# Tables as tables() makes them: padded and filled cells, header levels, headers, and body cells with their row.
TABLE_MODEL = rf"""
    wide as (select doc_id, table_index, min(start_line) as start_line, max(len(cells)) as width, max(row_no) + 1 as n_rows from kept group by all),
    grid as (
      select k.doc_id, k.table_index, row_no, c as col, coalesce(cells[c + 1], '') as value
      from kept k join wide w on k.doc_id = w.doc_id and k.table_index = w.table_index, unnest(generate_series(0, width - 1)) as t(c)
    ), filled as (
      select *, case when row_no = 0 then value else coalesce(last_value(nullif(value, '') ignore nulls) over (
        partition by doc_id, table_index, col, row_no > 0 order by row_no rows between unbounded preceding and current row), '') end as full_value from grid
    ), leveled as (
      select doc_id, table_index, case when count_if(row_no = 2) > 0 and count_if(row_no = 1 and full_value <> '') > 0
        and count_if(row_no = 1 and regexp_matches(full_value, '{HAS_NUMBER}')) = 0
        and count_if(row_no >= 2 and regexp_matches(full_value, '{HAS_NUMBER}')) >= count(distinct case when row_no >= 2 then row_no end) then 2 else 1 end as header_levels
      from filled group by all
    ), tops as (
      select doc_id, table_index, col, max(case when row_no = 0 then full_value end) as a, max(case when row_no = 1 then full_value end) as b from filled where row_no < 2 group by all
    ), heads as (
      select doc_id, table_index, col, header_levels, case when header_levels = 1 or coalesce(b, '') = '' or a = b then a when a = '' then b else a || ' / ' || b end as head
      from tops join leveled using (doc_id, table_index)
    ), body as (
      select doc_id, table_index, row_no - header_levels as row_index, col as column_index, full_value as value from filled join leveled using (doc_id, table_index) where row_no >= header_levels
    )"""


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("doc_lines", f"with {LINES} select doc_id, cast(line_no as integer) as line_no, line from lines")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lines(documents_of(spark, sf_dir))


@query(
    "doc_sections",
    f"""
    with {LINES}, {HEADINGS}, bodies as (
      select doc_id, section_no, trim(coalesce(string_agg(line, chr(10) order by line_no) filter (where level = 0), ''), {WS}) as text
      from numbered where section_no > 0 group by all
    )
    select n.doc_id, cast(n.section_no as integer) as section_no, cast(level as integer) as level, title, cast(line_no as integer) as line, b.text, 'heading' as source
    from numbered n join bodies b on n.doc_id = b.doc_id and n.section_no = b.section_no where level > 0
    union all
    select doc_id, 1, 1, 'document', null, trim(text, {WS}), 'fallback' from documents
    where trim(coalesce(text, ''), {WS}) <> '' and doc_id not in (select doc_id from marks where level > 0)
    """,
)
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.sections(documents_of(spark, sf_dir))


@query(
    "doc_table_cells",
    f"""
    with {LINES}, {TABLES}
    select doc_id, cast(table_index as integer) as table_index, cast(row_no as integer) as row_index, cast(generate_subscripts(cells, 1) - 1 as integer) as column_index, unnest(cells) as value
    from kept
    """,
)
def doc_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each(tables.raw_tables(documents_of(spark, sf_dir)), ["doc_id", "table_index"], "raw", "row_index", "row")
    return each(rows, ["doc_id", "table_index", "row_index"], "row", "column_index", "value")


@query(
    "doc_table_filled",
    f"""
    with {LINES}, {TABLES}, wide as (
      select doc_id, table_index, max(len(cells)) as width, max(row_no) + 1 as n_rows from kept group by all
    ), grid as (
      select k.doc_id, k.table_index, row_no, c as column_index, coalesce(cells[c + 1], '') as value
      from kept k join wide w on k.doc_id = w.doc_id and k.table_index = w.table_index, unnest(generate_series(0, width - 1)) as t(c)
    ), filled as (
      select *, case when row_no = 0 then value else coalesce(last_value(nullif(value, '') ignore nulls) over (
        partition by doc_id, table_index, column_index, row_no > 0 order by row_no rows between unbounded preceding and current row), '') end as full_value from grid
    )
    select doc_id, cast(table_index as integer) as table_index, cast(row_no as integer) as row_index, cast(column_index as integer) as column_index, full_value as value
    from filled where value = '' and full_value <> ''
    """,
)
def doc_table_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merged_cells(tables.tables(documents_of(spark, sf_dir)))


@query(
    "doc_tables",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, headed as (select doc_id, table_index, any_value(header_levels) as header_levels, string_agg(head, ' | ' order by col) as headers from heads group by all)
    select i.doc_id, cast(i.table_index as integer) as table_index, cast(i.start_line as integer) as start_line, coalesce(headers, '') as headers,
      cast(coalesce(n_rows - header_levels, 0) as integer) as row_count, cast(coalesce(width, 0) as integer) as column_count, coalesce(header_levels, 0) as header_levels
    from indexed i left join wide w on i.doc_id = w.doc_id and i.table_index = w.table_index left join headed h on i.doc_id = h.doc_id and i.table_index = h.table_index
    """,
)
def doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.tables(documents_of(spark, sf_dir))
    return found.select("doc_id", "table_index", "start_line", F.array_join("headers", " | ").alias("headers"), "row_count", "column_count", "header_levels")


TOTALS = f"""
    numbered as (select *, {cell_number_sql("value")} as number from body),
    flags as (select doc_id, table_index, row_index, bool_or(contains(lower(value), '合计') or contains(lower(value), '总计') or contains(lower(value), '小计') or contains(lower(value), 'total')) as total from body group by all),
    summed as (
      select n.*, total, sum(case when not total then number end) over above as computed, count(case when not total then number end) over above as value_count
      from numbered n join flags f on n.doc_id = f.doc_id and n.table_index = f.table_index and n.row_index = f.row_index
      window above as (partition by n.doc_id, n.table_index, n.column_index order by n.row_index rows between unbounded preceding and 1 preceding)
    ), outcomes as (
      select *, case when value_count < 2 then 'uncompared' when abs(coalesce(computed, 0) - number) <= greatest(0.01, least(1.0, abs(number) * 0.000001)) then 'verified' else 'mismatch' end as outcome
      from summed where total and number is not null
    ), issues_of_totals as (
      select doc_id, table_index, row_index, case when count_if(outcome = 'mismatch') > 0 then 'numeric_total_mismatch' when count_if(outcome = 'verified') > 0 then 'numeric_total_verified' else 'numeric_total_needs_review' end as code,
        case when count_if(outcome = 'mismatch') = 0 and count_if(outcome = 'verified') > 0 then 'info' else 'warning' end as level
      from outcomes group by all
    )"""


@query(
    "doc_total_checks",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {TOTALS}
    select doc_id, cast(table_index as integer) as table_index, cast(row_index as integer) as row_index, code, level from issues_of_totals
    """,
)
def doc_total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.total_issues(tables.total_checks(tables.tables(documents_of(spark, sf_dir))))


@query(
    "doc_numbers",
    rf"""
    with {LINES}, clean as (
      select doc_id, line_no, {inline_sql("regexp_replace(line, '<[^>]+>', ' ', 'g')")} as text from lines where regexp_matches(line, '[0-9]')
    ), spots as (
      -- every place a number may begin at, with the number that begins there
      select doc_id, line_no, text, i, regexp_extract(substr(text, i), '^({NUMERAL})(?:{BESIDE}|$)', 1) as token
      from clean, unnest(range(1, length(text) + 1)) as t(i)
      where regexp_matches(substr(text, i, 1), '[-+0-9]') and (i = 1 or regexp_matches(substr(text, i - 1, 1), '{BESIDE}'))
    ), reached as (
      select *, max(i + length(token)) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding) as reach from spots where token <> ''
    ), told as (
      select doc_id, line_no, substr(any_value(text), 1, 300) as text, string_agg(token, ' ' order by i) as numbers from reached where reach is null or reach <= i group by all
    )
    select doc_id, cast(line_no as integer) as line_no, text, numbers from (select *, row_number() over (partition by doc_id order by line_no) as no from told) where no <= 500
    """,
)
def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.numeric_facts(documents_of(spark, sf_dir))
    return found.select("doc_id", "line_no", "text", F.array_join("numbers", " ").alias("numbers"))


@query(
    "doc_dates",
    """
    with hits as (
      select doc_id, unnest(regexp_extract_all(text, '(?:20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}(?:日)?)|(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.]20[0-9]{2})')) as date,
        generate_subscripts(regexp_extract_all(text, '(?:20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}(?:日)?)|(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.]20[0-9]{2})'), 1) as pos
      from documents
    ), firsts as (select doc_id, date, min(pos) as pos from hits group by all),
    ranked as (select doc_id, row_number() over (partition by doc_id order by pos) as date_no, date from firsts)
    select doc_id, cast(date_no as integer) as date_no, date from ranked where date_no <= 50
    """,
)
def doc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.dates(documents_of(spark, sf_dir))


@query(
    "doc_anomaly_lines",
    f"""
    with {LINES}, hits as (
      select doc_id, line_no, trim(line, {WS}) as text from lines
      where regexp_matches(lower(line), '异常|风险|问题|复核|告警|缺陷|error|warning|risk|issue')
    ), ranked as (select *, row_number() over (partition by doc_id order by line_no) as rn from hits)
    select doc_id, cast(line_no as integer) as line_no, substr(text, 1, 300) as text from ranked where rn <= 50
    """,
)
def doc_anomaly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.signal_lines(documents_of(spark, sf_dir))


@query("doc_references")
def doc_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.references(documents_of(spark, sf_dir))


def is_key_sql(x: str) -> str:
    """Whether x may be a key, as is_key says."""
    word = r"[\p{L}\p{M}\p{N}\p{Pc}]"
    return f"(length({x}) between 1 and 60 and not regexp_matches({x}, '^{NUMERAL}$') and not starts_with({x}, 'http://') and not starts_with({x}, 'https://') and regexp_matches({x}, '{word}'))"


# Key-values: of each line its text without list mark, its pair and whether a paragraph stops at it; then the three sources.
KEY_VALUES = rf"""
    marked as (
      select doc_id, line_no, line, trim(trim(trim(regexp_replace(trim(line, {WS}), '^{SPACE}*(?:[-*•]|[0-9]+[.)、]|[（(]?[0-9]+[)）]){SPACE}*', ''), {WS}), '-*'), {WS}) as clean from lines
    ), keyed as (
      select *, strpos(clean, '：') as wide, strpos(clean, ':') as plain,
        {inline_sql("substr(clean, 1, greatest(strpos(clean, '：') - 1, 0))")} as key_w, {inline_sql("substr(clean, strpos(clean, '：') + 1)")} as value_w,
        {inline_sql("substr(clean, 1, greatest(strpos(clean, ':') - 1, 0))")} as key_p, {inline_sql("substr(clean, strpos(clean, ':') + 1)")} as value_p
      from marked
    ), tested as (
      select *, wide > 0 and {is_key_sql('key_w')} as by_wide, plain > 0 and {is_key_sql('key_p')} as by_plain from keyed
    ), parted as (
      select doc_id, line_no, line, clean, by_wide or by_plain as paired, case when by_wide then key_w else key_p end as key, case when by_wide then value_w else value_p end as value,
        starts_with(clean, '#') or regexp_matches(clean, '^{SPACE}*\|(.+)\|{SPACE}*$') or by_wide or by_plain as stops from tested
    ), looked as (
      select *, lead(clean, 1) over w as c1, lead(clean, 2) over w as c2, lead(clean, 3) over w as c3, lead(stops, 1) over w as s1, lead(stops, 2) over w as s2, lead(stops, 3) over w as s3
      from parted window w as (partition by doc_id order by line_no)
    ), ahead1 as (
      select *, coalesce(c1 <> '' and s1, false) as d1, case when c1 is null or c1 = '' or s1 then '' else c1 end as t1 from looked
    ), ahead2 as (
      select *, d1 or coalesce(c2 = '' and t1 <> '' or c2 <> '' and s2, false) as d2 from ahead1
    ), ahead3 as (
      select *, case when d2 or c2 is null or c2 = '' then t1 when t1 = '' then c2 else t1 || ' ' || c2 end as t2 from ahead2
    ), ahead4 as (
      select *, case when d2 or coalesce(c3 = '' and t2 <> '' or c3 <> '' and s3, false) or c3 is null or c3 = '' then t2 when t2 = '' then c3 else t2 || ' ' || c3 end as t3 from ahead3
    ), of_lines as (
      select doc_id, 0 as source, 0 as tbl, line_no as spot, key, case when value = '' then {inline_sql("t3")} else value end as value from ahead4 where paired and length(clean) <= 220
    ), two as (
      select doc_id, table_index from heads join wide using (doc_id, table_index) where width = 2 group by all
      having bool_or(lower(trim(head, {WS})) in {KEY_HEADERS + VALUE_HEADERS}) or count_if(trim(head, {WS}) <> '') = 2 and count_if(regexp_matches(head, '{HAS_NUMBER}')) = 0
    ), of_tables as (
      select doc_id, 1 as source, table_index as tbl, row_index as spot, max(value) filter (where column_index = 0) as key, max(value) filter (where column_index = 1) as value
      from body join two using (doc_id, table_index) group by all having key <> '' and value <> ''
    ), titled as (
      select *, {inline_sql(f"regexp_extract(trim(line, {WS}), '^(#{{1,6}}){SPACE}+(.+?){SPACE}*$', 2)")} as title,
        case when c1 <> '' then c1 when c2 <> '' then c2 when c3 <> '' then c3 end as first, case when c1 <> '' then s1 when c2 <> '' then s2 when c3 <> '' then s3 end as first_stops
      from looked
    ), of_headings as (
      select doc_id, 2 as source, 0 as tbl, line_no as spot, title as key, first as value from titled where length(title) between 1 and 60 and not first_stops and length(first) <= 180
    ), pairs as (
      select doc_id, source, tbl, spot, {inline_sql("key")} as key, {inline_sql("value")} as value from (from of_lines union all from of_tables union all from of_headings)
    ), firsts as (
      select doc_id, key, value, min((source, tbl, spot)) as place from pairs where length(key) between 1 and 60 and length(value) between 1 and 500 group by all
    ), kv as (
      select * from (select doc_id, cast(row_number() over (partition by doc_id order by place, key, value) - 1 as integer) as kv_index, key, value from firsts) where kv_index < 250
    )"""


@query("doc_key_values", f"with {LINES}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES} select doc_id, kv_index, key, value from kv")
def doc_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyvalues.key_values(documents_of(spark, sf_dir))


@query(
    "doc_key_value_map",
    f"with {LINES}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES} select doc_id, key, string_agg(value, ' | ' order by kv_index) as value_list from kv group by all",
)
def doc_key_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyvalues.key_value_map(keyvalues.key_values(documents_of(spark, sf_dir)))
    return found.select("doc_id", "key", F.array_join("value_list", " | ").alias("value_list"))


@query(
    "doc_recommendations",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES}, named as (
      select doc_id, 0 as rank, kv_index as spot, 'key_value' as source, key || ': ' || value as text from kv where regexp_matches(lower(key), '{"|".join(RECOMMENDATION_WORDS)}')
    ), asking as (
      select doc_id, 1 as rank, line_no as spot, 'line' as source, substr(trim(line, {WS}), 1, 300) as text from lines where regexp_matches(lower(line), '{"|".join(RECOMMENDATION_WORDS)}')
    ), every as (from named union all select * from asking where (doc_id, text) not in (select (doc_id, text) from named))
    select * from (select doc_id, cast(row_number() over (partition by doc_id order by rank, spot) as integer) as rec_no, source, text from every) where rec_no <= 50
    """,
)
def doc_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return facts.recommendations(docs, keyvalues.key_values(docs))


@query(
    "doc_field_evidence",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {KEY_VALUES}, stood as (
      select kv.doc_id, kv_index, min(line_no) as line_no from kv join lines l on kv.doc_id = l.doc_id and contains(line, key) and contains(line, value) group by all
    )
    select kv.doc_id, kv.kv_index, key, value, cast(s.line_no as integer) as line_no, cast(null as integer) as block_idx, cast(null as integer) as page_no,
      case when s.line_no is not null then 'markdown_line' else 'unknown' end as level, cast(case when s.line_no is not null and length(value) >= 2 then 0.72 else 0.45 end as double) as confidence,
      substr(coalesce({inline_sql("l.line")}, key || ': ' || value), 1, 300) as evidence_text
    from kv left join stood s on kv.doc_id = s.doc_id and kv.kv_index = s.kv_index left join lines l on s.doc_id = l.doc_id and s.line_no = l.line_no
    """,
)
def doc_field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return keyvalues.field_evidence(keyvalues.key_values(docs), docs)


@query(
    "doc_scalars",
    rf"""
    with base as (select doc_id, coalesce(text, '') as text from documents),
    cleaned as (
      select doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) as clean,
        lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'), {WS})) as norm from base
    )
    select doc_id, length(text) as n, md5(clean) as clean_md5, md5(norm) as norm_md5, cast(greatest(1, length(text) // 4) as integer) as tokens,
      coalesce(nullif(trim(regexp_replace(substr(text, 1, 40), '[^0-9A-Za-z_.:-]+', '_', 'g'), '_'), ''), 'document') as slug, sha256(text) as fingerprint
    from cleaned
    """,
)
def doc_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents_of(spark, sf_dir).select(
        "doc_id", F.length(text).cast("bigint").alias("n"), F.md5(T.clean_chunk_text(text)).alias("clean_md5"), F.md5(T.normalized(text)).alias("norm_md5"),
        T.estimate_tokens(text).alias("tokens"), T.slug(F.substring(text, 1, 40)).alias("slug"), F.sha2(text, 256).alias("fingerprint"),
    )


@query("doc_clean_text")
def doc_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.recovered_texts(documents_of(spark, sf_dir)).withColumnRenamed("text", "clean")


@query(
    "doc_redact",
    r"""
    select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***', 'g'),
      '(?i)((?:api[_-]?key|access[_-]?token|token|secret|signature)=)[^&\s]+', '\1***', 'g'), '(X-Amz-[A-Za-z-]+=)[^&\s]+', '\1***', 'g'),
      '(?i)(Authorization:\s*)[^\r\n]+', '\1***', 'g')) as masked_md5 from documents
    """,
)
def doc_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(spark, sf_dir).select("doc_id", F.md5(T.redact(F.coalesce("text", F.lit("")))).alias("masked_md5"))


RULES = f"""
    rules as (
      select doc_id, length(t) as n, trim(t, {WS}) = '' as blank, len(regexp_extract_all(t, '�|锟斤拷|Ã.|Â.')) as bad from (select doc_id, coalesce(text, '') as t from documents)
    ), counted as (
      select doc_id, cast(blank as integer) + cast(not blank and bad > 0 and bad / greatest(n, 1) > 0.02 as integer) as errors,
        cast(not blank and bad > 0 and bad / greatest(n, 1) <= 0.02 as integer) + cast(not blank and n < 200 as integer) as warnings
      from rules
    )"""


@query(
    "doc_quality",
    f"""
    with {RULES}
    select doc_id, cast(errors as bigint) as errors, cast(warnings as bigint) as warnings, cast(errors + warnings as bigint) as issue_count, cast(greatest(0, 100 - 30 * errors - 8 * warnings) as bigint) as score,
      case when errors > 0 then 'needs_review' when warnings > 0 then 'pass_with_warnings' else 'pass' end as status from counted
    """,
)
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scored = quality.graded_inline(docs, *quality.text_rules(F.col("text")))
    return scored.select("doc_id", "errors", "warnings", "issue_count", "score", "status")


@query(
    "doc_full_quality",
    f"""
    with {LINES}, {TABLES}, {TABLE_MODEL}, {TOTALS}, {KEY_VALUES}, {RULES}, shaped as (
      select doc_id, n >= 500 and doc_id not in (select doc_id from kv) and doc_id not in (select doc_id from found) and doc_id not in (
        select doc_id from lines where regexp_matches(line, '^(#{{1,6}}){SPACE}+(.+?){SPACE}*$')) as weak from rules
    ), of_totals as (select doc_id, count_if(level = 'warning') as warned, count_if(level = 'info') as told from issues_of_totals group by doc_id),
    added as (
      select c.doc_id, errors, warnings + cast(weak as integer) + coalesce(warned, 0) as warnings, coalesce(told, 0) as infos
      from counted c join shaped s on c.doc_id = s.doc_id left join of_totals t on c.doc_id = t.doc_id
    )
    select doc_id, cast(errors as bigint) as errors, cast(warnings as bigint) as warnings, cast(infos as bigint) as infos, cast(greatest(0, 100 - 30 * errors - 8 * warnings) as bigint) as score,
      case when errors > 0 then 'needs_review' when warnings > 0 then 'pass_with_warnings' else 'pass' end as status from added
    """,
)
def doc_full_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that a text, its structure and its totals can break."""
    docs = documents_of(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    # lines are read once for what is counted inside the row; only key-values are rows of their own
    rows = documents.with_lines(docs)
    counts = rows.select("doc_id", F.length("text").alias("chars"), F.size(documents.heading_marks(F.col("lines"))).alias("headings"), tables.table_count(F.col("lines")).alias("found"))
    pairs = keyvalues.key_values(docs).groupBy("doc_id").agg(F.count("*").alias("pairs"))
    counts = counts.join(pairs, "doc_id", "left").na.fill(0, ["pairs"])
    structure = quality.structure_rules(F.col("chars"), F.col("headings"), F.col("pairs"), F.col("found"))
    own = quality.issues(docs.select("doc_id", text.alias("text")), *quality.text_rules(F.col("text"))).unionByName(quality.issues(counts, *structure))
    totals = tables.total_issues(tables.total_checks(tables.tables(docs))).select("doc_id", "code", "level")
    return quality.score(own.unionByName(totals), docs).select("doc_id", "errors", "warnings", "infos", "score", "status")


@query(
    "doc_issue_histogram",
    f"""
    with {RULES}, hits as (
      select 'empty_markdown' as code, count_if(blank) as n from rules union all select 'possible_mojibake', count_if(not blank and bad > 0) from rules
      union all select 'short_text', count_if(not blank and n < 200) from rules
    ) select code, cast(n as bigint) as n from hits where n > 0
    """,
)
def doc_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return quality.issues(docs, *quality.text_rules(F.col("text"))).groupBy("code").agg(F.count("*").alias("n"))


@query("doc_best_attempt")
def doc_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against cleaned text, each graded; the better one wins and ties keep the raw text."""
    docs = documents_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tries = [("initial", docs), ("text_cleanup", docs.withColumn("text", T.clean_recovered_text(F.col("text"))))]
    graded = [
        quality.graded_inline(d, *quality.text_rules(F.col("text"))).select("doc_id", F.lit(i).alias("attempt_no"), F.lit(name).alias("name"), "status", "score", "errors", "warnings")
        for i, (name, d) in enumerate(tries)
    ]
    return quality.best_attempt(graded[0].unionByName(graded[1]))


@query("doc_text_blocks")
def doc_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_blocks(documents_of(spark, sf_dir))


@query("doc_chunks")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.text_chunks(documents_of(spark, sf_dir))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks as (doc_id, block_ord, type, text, page_idx), a document being a file in a run."""
    rows = table(spark, sf_dir, "complex_financial_report_content_list")
    return rows.select(F.concat_ws("/", "file_key", "run_id").alias("doc_id"), F.col("block_id").alias("block_ord"), "type", "text", "page_idx")


@query(
    "block_summary",
    """
    with b as (select concat_ws('/', file_key, run_id) as doc_id, coalesce(type, 'unknown') as type, text, page_idx from complex_financial_report_content_list),
    t as (select doc_id, type, count(*) as n from b group by all)
    select b.doc_id, count(*) as item_count, cast(count(distinct page_idx) as integer) as page_count, cast(sum(length(coalesce(text, ''))) as bigint) as text_characters,
      (select string_agg(t.type || '=' || t.n, ',' order by t.type) from t where t.doc_id = b.doc_id) as type_counts,
      case when count(distinct page_idx) > 0 then 'page' else 'document' end as provenance_level
    from b group by b.doc_id
    """,
)
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.content_summary(layout_blocks(spark, sf_dir))


@query("block_chunks")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_chunks(layout_blocks(spark, sf_dir)).drop("pages")


@query(
    "block_skips",
    rf"""
    with b as (select concat_ws('/', file_key, run_id) as doc_id, block_id, coalesce(type, 'unknown') as type, trim(coalesce(text, ''), {WS}) as body from complex_financial_report_content_list),
    k as (
      select *, type in {blocks.NOISE_TYPES} as noise, type not in {blocks.NOISE_TYPES} and (type in {blocks.HEADING_TYPES} or regexp_matches(body, '^#{{1,6}}{SPACE}+\S+') and not contains(body, chr(10))) as heading,
        coalesce(nullif(trim(regexp_replace(regexp_replace(body, '^#{{1,6}}{SPACE}+', ''), '{SPACE}+', ' ', 'g'), {WS}), ''), 'document') as title,
        case when type in {blocks.CONTENT_TYPES["text"]} then 'text' when type = 'table' then 'table' when type in {blocks.CONTENT_TYPES["figure"]} then 'figure'
          when type in {blocks.CONTENT_TYPES["formula"]} then 'formula' else 'unsupported' end as content
      from b
    ), t as (
      select *, regexp_matches(lower(coalesce(last_value(case when heading then title end ignore nulls) over (partition by doc_id order by block_id rows between unbounded preceding and current row), 'document')),
        '^{SPACE}*(contents|table of contents|list of figures|list of tables|revision history|document history|change history){SPACE}*$') as low from k
    ), r as (
      select type, case when noise then 'noise' when heading then case when low then 'low_value_section' else 'heading' end when low then 'inside_low_value_section' when content = 'unsupported' then 'unsupported'
        when body = '' then case content when 'text' then 'empty_text' when 'table' then 'empty_table' when 'figure' then 'weak_figure' else 'empty_formula' end end as reason from t
    ) select type, reason, count(*) as n from r where reason is not null and reason <> 'heading' group by all
    """,
)
def block_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.classified_blocks(layout_blocks(spark, sf_dir)).where("reason is not null and reason <> 'heading'")
    return rows.groupBy("type", "reason").agg(F.count("*").alias("n"))


@query("block_field_evidence")
def block_field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-values of each run's text, with the block and the page they stand on."""
    rows = layout_blocks(spark, sf_dir)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    docs = rows.groupBy("doc_id").agg(joined.alias("text"))
    return keyvalues.field_evidence(keyvalues.key_values(docs), docs, rows.withColumn("source", F.lit("parser")))
