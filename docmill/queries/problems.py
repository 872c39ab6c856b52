"""Queries of the general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.operators import nested
from docmill.queries import REGISTRY
from docmill.session import table

query = REGISTRY.query


AROUND = "chr(32)||chr(9)||chr(13)||chr(10)||chr(65279)"


def json_of(text: str) -> str:
    """The JSON value in a text, null if it can't be read in full."""
    return f"(case when json_valid(trim({text}, {AROUND})) then cast(trim({text}, {AROUND}) as json) end)"


def held_sql(value: str) -> str:
    """The JSON value, or what it holds as text."""
    return f"(case when json_type({value}) = 'VARCHAR' then {json_of(f"({value} ->> '$')")} else {value} end)"


def items_sql(value: str) -> str:
    """Items of a JSON list, an object as a list of one, as a list of JSON values."""
    return f"(case json_type({value}) when 'ARRAY' then cast({value} as json[]) when 'OBJECT' then [{value}] else cast([] as json[]) end)"


def records_sql(table: str, key: str, wrapper: str, name: str) -> str:
    """CTEs (record, position, item): the items of a list of each record, as objects."""
    return f"""
    parsed as (select {key} as record_id, {held_sql(json_of("payload"))} as outside from {table}),
    opened as (select record_id, outside, {held_sql(f"json_extract(outside, '$.{wrapper}')")} as inside from parsed where json_type(outside) = 'OBJECT'),
    records as (select record_id, case when json_type(inside) = 'OBJECT' then inside else outside end as record from opened),
    listed as (select record_id, {held_sql(f"json_extract(record, '$.{name}')")} as list from records),
    placed as (select record_id, unnest({items_sql("list")}) as item, generate_subscripts({items_sql("list")}, 1) - 1 as position from listed),
    items as (select record_id, position, {held_sql("item")} as item from placed),
    objects as (select * from items where json_type(item) = 'OBJECT')"""


def whole_sql(value: str) -> str:
    """BIGINT of a whole number however it is written."""
    text = f"trim({value} ->> '$', {AROUND})"
    scaled = f"try_cast({text} as decimal(38, 15))"
    return f"""(case when json_type({value}) in ('OBJECT', 'ARRAY', 'BOOLEAN') then null when regexp_matches({text}, '^[+-]?[0-9]+([.]0*)?$') then try_cast(regexp_replace({text}, '[.]0*$', '') as bigint)
      when regexp_matches({text}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)[eE][+-]?[0-9]+$') and {scaled} = floor({scaled}) then try_cast({scaled} as bigint) end)"""


def counts_sql(holder: str) -> str:
    """Rows (record_id, parent, field, n) of the count groups in holder (record_id, parent, detail)."""
    return " union all ".join(
        f"""
        select record_id, h.parent, '{group}.' || e.key as field, {whole_sql("e.value")} as n
        from (select record_id, parent, {held_sql(f"json_extract(detail, '$.{group}')")} as counts from {holder}) h, json_each(case when json_type(counts) = 'OBJECT' then counts end) e
        union select record_id, parent, '{group}.' || (entry ->> '$.name'), {whole_sql("json_extract(entry, '$.count')")}
        from (select record_id, parent, unnest(cast(counts as json[])) as entry from (select record_id, parent, {held_sql(f"json_extract(detail, '$.{group}')")} as counts from {holder}) where json_type(counts) = 'ARRAY')
        where json_type(entry) = 'OBJECT'"""
        for group in ("source_counts", "semantic_signal_counts")
    )


TRACE_ROWS = f"""
    with {records_sql("trace", "trace_id", "trace", "steps")},
    steps as (select record_id, 'steps/' || position as parent, {held_sql("json_extract(item, '$.detail')")} as detail from objects),
    tried as (select record_id, parent, {held_sql("json_extract(detail, '$.attempts')")} as attempts from steps where json_type(detail) = 'OBJECT'),
    attempts as (select record_id, parent || '/attempts/' || (generate_subscripts({items_sql("attempts")}, 1) - 1) as parent, unnest({items_sql("attempts")}) as attempt from tried),
    attempted as (select record_id, parent, {held_sql("attempt")} as attempt from attempts),
    holders as (
      select record_id, parent, detail from steps where json_type(detail) = 'OBJECT'
      union all select record_id, parent, {held_sql("json_extract(attempt, '$.detail')")} from attempted where json_type(attempt) = 'OBJECT'
    )
    select 'trace' as tbl, * from ({counts_sql("holders")}) where n is not null"""
SCORE_ROWS = f"""
    with {records_sql("llm_impact_report", "report_id", "llm_impact_report", "pairs")},
    sides as (
      select record_id, 'pairs/' || position as parent, side || '.quality_score' as field, {held_sql("json_extract(item, '$.' || side)")} as value from objects, (values ('baseline'), ('llm')) as s(side)
    )
    select record_id, parent, field, {whole_sql("json_extract(value, '$.quality_score')")} as n from sides where json_type(value) = 'OBJECT'"""


@query("p1_found", f"select * from ({TRACE_ROWS}) union all select 'llm_impact_report', * from ({SCORE_ROWS}) where n is not null")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nested_counts(table(spark, sf_dir, "trace"), table(spark, sf_dir, "llm_impact_report"))


STEP_ROWS = f"""
    with {records_sql("trace", "trace_id", "trace", "steps")}, steps as (
      select record_id, position, item, {held_sql("json_extract(item, '$.detail')")} as detail from objects
    ), tried as (select *, case when json_type(detail) = 'OBJECT' then {held_sql("json_extract(detail, '$.attempts')")} end as attempts from steps)
    select record_id, cast(position as integer) as step_no, item ->> '$.name' as name, item ->> '$.status' as status, item ->> '$.started_at' as started_at, item ->> '$.ended_at' as ended_at,
      cast(len({items_sql("attempts")}) as integer) as n_attempts from tried"""
CALL_ROWS = f"""
    with {records_sql("trace", "trace_id", "trace", "tool_calls")}
    select record_id, cast(position as integer) as call_no, item ->> '$.tool' as tool, item ->> '$.status' as status, try_cast(item ->> '$.elapsed_seconds' as double) as elapsed_seconds from objects"""


@query("p1_steps", STEP_ROWS)
def p1_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.trace_steps(table(spark, sf_dir, "trace"))


@query("p1_tool_calls", CALL_ROWS)
def p1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tool_calls(table(spark, sf_dir, "trace"))
