"""Counters, whole files, dumps and the table that grows."""

import duckdb

from lattica.functions.naming import typed_path
from lattica.operators import buildings, mesh, trees
from lattica.plans import synth


def test_counters_of_a_search(spark):
    rows = [(x, 0, z, "sandstone") for x in range(3) for z in range(3)]  # all of one discardable name
    rows += [(10, 0, 0, "oak_planks"), (11, 0, 0, "oak_planks")]  # tiny
    rows += [(20 + x, y, z, "oak_planks" if y else "cobblestone") for x in range(3) for z in range(3) for y in range(3)]
    rows += [(40 + x, 5, 0, n) for x, n in enumerate(("oak_planks", "glass", "glass", "oak_planks"))]
    rows += [(60, 0, 0, "stone")]
    counters = buildings.Counters()
    found = buildings.find_buildings(spark.createDataFrame(rows, "x int, y int, z int, name string"), counters)
    assert found.count() == 31
    assert tuple(counters.row().first()) == (len(rows), 4, 1, 1, 2, 31)
    empty = buildings.Counters()
    buildings.find_buildings(spark.createDataFrame([], "x int, y int, z int, name string"), empty)
    assert tuple(empty.row().first()) == (0,) * 6


def test_an_obj_file_as_a_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mesh, "ROWS_AT_ONCE", 5)
    blocks = spark.createDataFrame([(x, y, 0, "oak_log" if y else "stone") for x in range(3) for y in range(2)], "x int, y int, z int, name string")
    quads = mesh.faces(blocks).withColumn("material", mesh.F.when(mesh.F.col("name") == "stone", "other").otherwise("wood"))
    vertex = mesh.vertices(quads)
    lines = mesh.obj_lines(vertex, mesh.indexed(quads, vertex, "material"), "own é.mtl")
    size = mesh.write_file(lines, str(tmp_path / "own.obj"), "part", "name", "k")
    data = (tmp_path / "own.obj").read_bytes()
    got = data.decode().splitlines()
    assert len(data) == size and got[0] == "mtllib own é.mtl" and len(got) == lines.count()
    corners = [tuple(map(int, line.split()[1:])) for line in got if line.startswith("v ")]
    assert corners == sorted({(x, y, z) for x in range(4) for y in range(3) for z in range(2)})
    names, used = [], {}
    for line in got:
        if line.startswith("usemtl "):
            names.append(line[7:])
        elif line.startswith("f "):
            used[names[-1]] = used.get(names[-1], 0) + 1
            assert len({corners[int(k) - 1] for k in line.split()[1:]}) == 4
    assert names == ["other", "wood"] and used == {"other": 11, "wood": 11}
    assert mesh.write_file(lines.where("false"), str(tmp_path / "none.obj"), "part", "name", "k") == 0


def test_lines_of_trees(spark):
    blocks = spark.createDataFrame([(0, 0, 0, "dirt", None), (0, 1, 0, "oak_log", "axis=y"), (0, 2, 0, "oak_leaves", None), (9, 1, 9, "oak_leaves", "None")], "x int, y int, z int, name string, prop string")
    found = trees.components(trees.stored(trees.relevant(blocks), "lines"))
    got = trees.tree_lines(found, blocks).orderBy("tree_id", trees.F.desc("y"), "x", "z").collect()
    assert [r.line for r in got] == ["oak_leaves:None:0.2.0", "oak_log:axis=y:0.1.0", "dirt:None:0.0.0", "oak_leaves:None:9.1.9"]


def test_typed_paths():
    assert typed_path(' "C:\\\\saves\\\\world\\\\" '.replace("\\\\", "\\")) == "C:/saves/world" and typed_path("'a b/c/'") == "a b/c"


def test_the_table_grows_with_its_rows(spark, tmp_path, monkeypatch):
    """With few rows to a square, x and z reach as far in Spark as in SQL."""
    base = "/root/testdata/sf0.001"
    assert synth.blocks(spark, base).agg({"x": "max"}).first()[0] < 48
    monkeypatch.setattr(synth, "ROWS", 1000)
    grown = synth.GROWN.replace("1000000.0", "1000.0")
    got = sorted((r.x, r.y, r.z, r.name) for r in synth.blocks(spark, base).collect())
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{base}/lineitem.parquet'")
    want = db.execute(f"with {synth.VOX.replace(synth.GROWN, grown)} select x, y, z, name from vox").fetchall()
    assert got == sorted(want) and max(r[0] for r in got) > 48
