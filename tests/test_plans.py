"""The physical plans are the intended ones."""

import re

import pytest

from civictally.plans import core_queries

QUERIES = core_queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_joins_and_whole_columns_only_where_needed(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_flagship(spark, data):
    text = plan(QUERIES["donor_rollup_top30"](spark, data))
    assert text.count("WindowGroupLimit") == 2 and "IsNotNull(contribution_amount)" in text
    read = next(x for x in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if "contribution_amount" in x)
    assert "received_at" not in read and "period_beg_date" not in read


def test_snapshots_place_rows_by_key_once(spark, data):
    text = plan(QUERIES["p2_found"](spark, data))
    # distinct rows, the list of deliveries and the placement by key; no exchange for the cells
    assert len(re.findall(r"hashpartitioning\(k#\d+L?, ", text)) <= 2
    assert not re.search(r"hashpartitioning\(k#\d+L?, pair", text)


def test_parsing_is_map_only(spark, data):
    assert "Exchange" not in plan(QUERIES["p5_found"](spark, data))
