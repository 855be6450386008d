"""Queries whose large sides are never broadcast through the driver, most of them measured over lineitem at 60 times sf0.1 (README)."""

import pytest

import __spark_entry__ as entry
from lattica.operators import graph
from lattica.plans import queries

DIR = "/root/testdata/sf0.001"
#: In plans: the starts of ranges and who was worked on again, a row per range or tile.
FEW = ("_range#", "sender#")


@pytest.mark.parametrize(
    "name",
    [
        "axis_check",
        "below_footprint",
        "below_footprint_all",
        "building_counters",
        "building_merge",
        "building_raw",
        "building_rewrite",
        "building_search_counters",
        "discard_tiny",
        "discard_uniform",
        "foliage_attach",
        "log_reach_approx",
        "plane_cc8",
        "sandwich_pairs",
        "square_cells_approx",
        "stump_ground",
        "stump_select",
        "touch_pairs",
        "tree_classify",
        "tree_components",
    ],
)
def test_large_sides_are_not_broadcast(spark, monkeypatch, name):
    """Of tables so small Spark would broadcast any that it may. Written plans and the returned one are looked at."""
    plans, stored = [], queries.stored

    def watched(df, to):
        if not to.startswith("reach-front"):  # a frontier is broadcast only if it is counted as short
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, to)

    for module in (queries, queries.trees, queries.buildings, graph):
        monkeypatch.setattr(module, "stored", watched)
    plans.append(entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString())
    lines = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(plans) > 1 and [line for line in lines if not any(few in line for few in FEW)] == []
