"""What must not grow on the driver or in a task, and colours of buildings of any number."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lattica.operators import mesh, trees
from lattica.operators.shapes import Plane, is_square, l_cells
from lattica.plans import queries, synth

DIR = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


@pytest.mark.parametrize("name", ["plane_cc8", "below_footprint_all", "sandwich_pairs", "building_counters", "adoption_edges_approx", "stump_select", "foliage_attach", "axis_check", "log_reach_approx", "tree_dump", "tree_rewrite"])
def test_nothing_that_grows_is_broadcast(spark, monkeypatch, name):
    """These tables are small, so Spark would broadcast wherever it is left to choose, as it does for large ones whose files are small."""
    seen, stored = [], queries.stored

    def watched(df, to):
        seen.extend(joins(df) if not to.startswith("reach-front") else [])
        return stored(df, to)

    for module in (queries, queries.trees, queries.buildings, entry.plans.connected_components):
        monkeypatch.setitem(getattr(module, "__globals__", None) or vars(module), "stored", watched)
    seen += joins(entry.queries()[name](spark, DIR))
    assert [line for line in seen if "_range" not in line] == []  # a row per range, in order.numbered


def test_places_are_dealt_before_they_are_sorted(spark):
    plan = synth.blocks(spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]


def test_colours_of_buildings_of_any_number(spark):
    _, _, rest = queries.SQL["building_materials"].partition("own AS (")
    ids = [-100_003, -21, -2, -1, 0, 1, 7, 1_000_003]
    parts = ", ".join(f"({i})" for i in ids)
    want = duckdb.sql(f"WITH parts(building_id) AS (VALUES {parts}), own AS ({rest}").fetchall()
    found = mesh.materials(spark.createDataFrame([(i,) for i in ids], "building int")).where("material like 'building%'")
    got = [(r.material, round(r.r, 6), round(r.g, 6), round(r.b, 6)) for r in found.collect()]
    assert sorted(got) == sorted((m, float(r), float(g), float(b)) for m, r, g, b in want)


def test_layers_of_one_block_need_no_python(spark):
    """Small trees at random: as plane by plane, though layers of one block go to no Python task."""
    chance, rows = random.Random(3), []
    for tree in range(150):
        at = {(chance.randrange(3), chance.randrange(3), chance.randrange(4)) for _ in range(chance.randrange(1, 7))}
        rows += [(tree, x - 5, y, z + 7, chance.choice(("log", "log", "leaf"))) for x, y, z in sorted(at)]
    cells = spark.createDataFrame(rows, "tree_id long, x int, y int, z int, material string")
    squares, ls, several = set(), set(), set()
    for tree in range(150):
        own = [r for r in rows if r[0] == tree]
        x0, z0 = min(r[1] for r in own), min(r[3] for r in own)
        shape = max(r[1] for r in own) - x0 + 1, max(r[3] for r in own) - z0 + 1
        for y in {r[2] for r in own}:
            filled, under = np.zeros(shape, bool), np.zeros(shape, bool)
            for _, x, level, z, _ in own:
                (filled if level == y else under if level == y - 1 else np.zeros(shape, bool))[x - x0, z - z0] = True
            anchors = sorted((r[1] - x0, r[3] - z0) for r in own if r[2] == y and r[4] == "log")
            plane = Plane(filled, under)
            squares |= {(tree, i + x0, j + z0) for i, j in anchors if is_square(plane, i, j)}
            ls |= {(tree, i + x0, j + z0) for i, j in l_cells(plane, anchors)}
            several |= {(tree, y)} if filled.sum() > 1 and anchors else set()
    assert {tuple(r) for r in trees.square_columns(cells).collect()} == squares
    assert {tuple(r) for r in trees.l_columns(cells).collect()} == ls
    plan = trees.square_columns(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert squares and ls and several and "NOT (first#" in plan.split("FlatMapGroupsInArrow")[1]


def test_layers_go_to_python_in_lots_that_are_dealt_out(spark):
    """By tree and level they were calls of a few cells each, in the few partitions that adaptive execution had left of a join."""
    rows = [(tree, x, y, 0, "log") for tree in range(40) for y in range(3) for x in range(1 + tree % 3)]
    rows += [(100, x, 0, z, "log") for x in range(9) for z in range(9)]  # more than trees.FEW
    found = trees.square_columns(spark.createDataFrame(rows, "tree_id long, x int, y int, z int, material string"))
    assert {tuple(r) for r in found.collect()} == {(tree, 0, 0) for tree in range(0, 40, 3)} | {(100, 0, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow", 1)[1]
    assert plan.startswith(" [lot#") and "REPARTITION_BY_NUM" in plan[: plan.index("SortMergeJoin")]


def test_squares_of_few_cells_are_those_of_many():
    chance = np.random.default_rng(5)
    for _ in range(400):
        filled, under = chance.random((5, 6)) < 0.6, chance.random((5, 6)) < 0.3
        cells = lambda grid: {(int(i), int(j)) for i, j in np.argwhere(grid)}
        many, few = Plane(filled, under), Plane.of_few(cells(filled), cells(filled & ~under), (5, 6))
        anchors = sorted(cells(filled))
        assert [is_square(few, *a) for a in anchors] == [is_square(many, *a) for a in anchors]
        assert l_cells(few, anchors) == l_cells(many, anchors)
