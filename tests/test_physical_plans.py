"""What the plans must keep to: no shuffle where none is needed, no nested loops, only the columns that are read."""

import re

import pytest

from docmill.queries import REGISTRY

SF = "/root/testdata/sf0.001"
WITHIN_ROWS = ["doc_lines", "doc_sections", "doc_table_cells", "doc_table_filled", "doc_tables", "doc_numbers", "doc_dates", "doc_anomaly_lines", "doc_scalars", "doc_quality", "doc_text_blocks", "p1_steps", "p1_tool_calls", "doc_html_blocks", "chunk_html_tables", "event_props"]


def plan(spark, name):
    df = REGISTRY.queries[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WITHIN_ROWS)
def test_per_document_operators_do_not_shuffle(spark, name):
    """Beyond spreading the rows of a scan of one small file over the cores."""
    assert all("REPARTITION_BY_NUM" in line for line in plan(spark, name).split("\n") if "Exchange" in line)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_no_query_multiplies_tables(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_scans_read_what_is_used(spark):
    (schema,) = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan(spark, "doc_sections")))
    assert schema == "struct<doc_id:bigint,text:string>"
    assert "url:" not in plan(spark, "doc_quality")


def test_rank_limits_run_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "memory_stats") and "WindowGroupLimit" in plan(spark, "chunk_search")
