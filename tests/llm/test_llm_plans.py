"""What the plans of the llm operators must keep to."""

import re

import pytest

from docmill.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return REGISTRY.queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p3_found", "p3_repaired", "p5_found", "p5_pieces", "p5_ranges", "p7_ids"])
def test_scans_that_need_no_shuffle_have_none(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["p2_found", "p2_canonical", "p4_found", "p8_containers", "p9_found"])
def test_tables_are_never_multiplied(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_packing_shuffles_no_text(spark):
    text = plan(spark, "p8_containers")
    assert text.count("Exchange") == 1 and "body" not in text[: text.index("Exchange")]
