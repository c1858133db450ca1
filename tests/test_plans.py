"""Physical plans: no products of data, columns pruned at the scan, filters pushed to it."""

import re

import pytest

from ridgeline.plans import queries as Q
from ridgeline.plans import queries_more, queries_view  # noqa: F401
from ridgeline.sources.surrogate import model_table

#: Their surrogate terrain, or a summary of one row, is crossed with a few literals.
WITH_LITERALS = {"dem", "residuals", "anchor", "terrain", "summary", "shape", "tuple_in", "dem_lookup", "anchored"}
EAGER = {"match_sessions"}  # runs its steps as it is built


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - EAGER))
def test_no_products(spark, sf, name):
    text = plan(Q.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    if not any(k in name for k in WITH_LITERALS):
        assert "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    text = formatted(Q.QUERIES["line_slopes"](spark, sf))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", text)[1])) == {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus"}
    text = formatted(model_table(spark, sf, "samples").where("session_id = 5").select("id"))
    assert "EqualTo(user_id,5)" in text and "props" not in re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
