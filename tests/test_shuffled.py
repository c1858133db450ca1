"""Sides that explode or aggregation have made are shuffled, whatever Spark's estimate of them is."""

import re

import pytest

from ridgeline.operators import growth as Y
from ridgeline.operators import match as X
from ridgeline.operators import model as M
from ridgeline.operators import windows as W
from ridgeline.plans import queries as Q
from ridgeline.plans import queries_more as MORE
from ridgeline.plans.storage import saved
from ridgeline.sources.surrogate import model_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "match_candidates", "match_nearest", "match_sweep", "link_frontage", "link_plan",
])
def test_no_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in plan(Q.QUERIES[name](spark, sf))


def test_growth_broadcasts_no_lines(spark, sf):
    segments, runs, *model = [model_table(spark, sf, t) for t in ("segments", "runs", "buckets", "coverage", "lines")]
    ways = MORE._lines(segments)
    near = X.end_neighbours(ways, 5.0)
    # the nodes of more than CROWD ends, a row for CROWD ends, may be
    assert all("[node#" in x for x in re.findall(r"BroadcastHashJoin.*", plan(near)))
    extents = M.extents(*model).select("segment_id", "direction", "from_m", "to_m")
    out = Y.arcs(saved(ways.select("id", "line", "length_m", "street_name")), saved(near), saved(extents), saved(W.transitions(runs)))
    assert "BroadcastHashJoin" not in plan(out)
