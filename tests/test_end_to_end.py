"""A world from files to a report and back to files, against the steps worked out on strings."""

import json
import random

import pytest

from lattica.operators import buildings, encode, report, trees, worlds

BLOCKS = "x int, y int, z int, name string, prop string, ns string"


def places():
    """Ground, a tree, loose foliage, two houses, and odd rows: null properties, names and namespaces."""
    rng = random.Random(3)
    world = {(x, 0, z): ("grass_block", "None", "minecraft") for x in range(-8, 20) for z in range(-4, 12)}
    for y in range(1, 6):
        world[0, y, 0] = ("oak_log", "axis=y", "minecraft")
    for x in range(-2, 3):
        for z in range(-2, 3):
            world[x, 6, z] = ("oak_leaves", "distance=1", "minecraft")
    world[15, 9, 9] = ("birch_leaves", None, "minecraft")
    for x0, z0, wall in ((6, 1, "oak_planks"), (13, 2, "bricks")):
        for x in range(x0, x0 + 4):
            for z in range(z0, z0 + 4):
                for y in range(1, 4):
                    world[x, y, z] = (wall, "None", None) if rng.random() < 0.8 else ("oak_stairs", "facing=east,half=top,waterlogged=false", "mod")
                world[x, 4, z] = ("glass", "None", "minecraft")
    world[-8, 7, 11] = (None, None, None)
    return world


@pytest.mark.parametrize("spaced", [True, False])
def test_from_files_to_report(spark, tmp_path, spaced):
    rows = [(*p, *b) for p, b in places().items()]
    blocks = spark.createDataFrame(rows, BLOCKS).repartition(3)
    if not spaced:
        blocks = blocks.drop("ns")
    files = worlds.save(worlds.encoded(blocks), f"{tmp_path}/a")
    assert files.agg({"records": "sum"}).first()[0] == len(rows)
    world = worlds.load(spark, f"{tmp_path}/a")
    filled = lambda p, n, r, s: (*p, n or "other", r or "None", *[s or "minecraft"] * spaced)
    assert sorted(map(tuple, world.blocks().collect())) == sorted(filled(p, *b) for p, b in places().items())

    if not spaced:
        return

    bare = worlds.without_trees(world)
    worlds.save(bare, f"{tmp_path}/b")
    bare = worlds.load(spark, f"{tmp_path}/b")
    plain = spark.createDataFrame([filled(p, *b)[:5] for p, b in places().items()], "x int, y int, z int, name string, prop string")
    want = {(r.x, r.y, r.z): r.name for r in trees.remove_trees(plain).collect()}
    got = {(r.x, r.y, r.z): r.name for r in bare.blocks().collect()}
    assert got == want and got[0, 1, 0] == "tree_marker" and got[15, 9, 9] == "foliage_marker" and (0, 3, 0) not in got

    marked = worlds.with_buildings(bare)
    worlds.save(marked, f"{tmp_path}/c")
    marked = worlds.load(spark, f"{tmp_path}/c")
    stripped = spark.createDataFrame([(*p, n) for p, n in want.items()], "x int, y int, z int, name string")
    owners = {(r.x, r.y, r.z): r.building_id for r in buildings.find_buildings(stripped).collect()}
    code = encode.code_of(marked.names, worlds.BUILDING_MARKER)
    assert {(r.x, r.y, r.z): r.prop for r in marked.codes.where(f"id = {code}").collect()} == owners and len(set(owners.values())) >= 2
    assert {(r.x, r.y, r.z) for r in marked.codes.collect()} == set(want)

    found = worlds.structures(marked, bare)
    assert {(r.building_id, r.x, r.y, r.z, r.name) for r in found.collect()} == {(b, *p, want[p]) for p, b in owners.items()}
    texts = {r.id: json.loads(r.json) for r in report.as_json(found).collect()}
    assert texts == {r.id: json.loads(r.json) for r in report.as_json(found.repartition(7)).collect()}  # in the same order
    for b, text in texts.items():
        own = sorted(p for p, o in owners.items() if o == b)
        assert text["count"] == len(own) and [(t["x"], t["y"], t["z"]) for t in text["blocks"]] == [p for p in own if want[p] == "oak_stairs"]
        assert all(t["p"] == {"facing": "east", "half": "top"} and t["n"] == "oak_stairs" for t in text["blocks"])
        cubes = {p for p in own if want[p] != "oak_stairs"}
        faces = sum((x + dx, y + dy, z + dz) not in cubes for x, y, z in cubes for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
        assert sum(len(m["pos"]) for m in text["cubeMeshes"]) == faces * 18
    parts = report.tiles(found).collect()
    assert all(r["count"] <= report.TILE**3 and r.tile_x == r.bbox[0] // 16 for r in parts)
    for b, text in texts.items():
        own = [r for r in parts if r.id == b]
        assert sum(r["count"] for r in own) == text["count"] and sum(len(m.pos) for r in own for m in r.cubeMeshes) == sum(len(m["pos"]) for m in text["cubeMeshes"])
    report.write_page(found, "w", f"{tmp_path}/page.html")


def test_what_dictionaries_lack(spark, tmp_path):
    blocks = spark.createDataFrame([(0, 0, 0, "stone", None, None), (1, 0, 0, None, "a=1", "mod"), (2, 0, 0, "dirt", "b=2", "mod")], BLOCKS)
    names, props, spaces = encode.dictionaries(blocks.where("x < 2"))
    assert {r.name for r in names.collect()} == {"stone", "other"} and {r.raw for r in props.collect()} == {"None", "a=1"} and {r.space for r in spaces.collect()} == {"minecraft", "mod"}
    rows = encode.encoded(blocks, names, props, spaces)
    assert sorted((r.x, r.id is None, r.prop is None, r.ns is None) for r in rows.collect()) == [(0, False, False, False), (1, False, False, False), (2, True, True, False)]
    with pytest.raises(Exception, match="in no dictionary"):
        worlds.save(worlds.World(rows, names, props, spaces), str(tmp_path / "w"))
    with pytest.raises(LookupError):
        encode.code_of(names, "building_marker")
