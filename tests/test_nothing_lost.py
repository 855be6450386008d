"""Rows without a code or a name stay, and callers' columns too."""

from lattica.operators import encode, trees
from lattica.operators.order import numbered


def test_remapped_keeps_rows_without_a_code(spark):
    rows = spark.createDataFrame([(0, 1, 10), (1, 2, 11), (None, 3, 12), (9, 4, 13), (2, 5, 14)], "id int, x int, _new int")
    old = spark.createDataFrame([(0, "a"), (1, "b"), (2, "gone")], "id int, name string")
    new = spark.createDataFrame([(7, "b"), (8, "a"), (9, "c")], "id int, name string")
    got = encode.remapped(rows, old, new)
    assert got.columns == rows.columns
    assert sorted((r.x, r.id, r._new) for r in got.collect()) == [(1, 8, 10), (2, 7, 11), (3, None, 12), (4, None, 13), (5, None, 14)]


def test_numbered_leaves_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k, -k, 2 * k, 3 * k, 4 * k) for k in range(50)], "v int, _place int, _range int, _before int, _n int").repartition(5)
    got = numbered(rows, ["_place"], "number", 1)
    assert got.columns == [*rows.columns, "number"]
    assert sorted(map(tuple, got.collect())) == [(k, -k, 2 * k, 3 * k, 4 * k, 50 - k) for k in range(50)]


def test_nameless_blocks_are_no_trees(spark):
    blocks = spark.createDataFrame([(0, 0, 0, "oak_log", "axis=y"), (0, 1, 0, None, None), (0, -1, 0, "dirt", None)], "x int, y int, z int, name string, prop string")
    assert sorted((r.y, r.material) for r in trees.relevant(blocks).collect()) == [(-1, None), (0, "log")]
    assert trees.remove_trees(blocks).where("y = 1").first().name is None
