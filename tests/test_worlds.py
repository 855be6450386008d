"""Blocks, meshes, graphs, trees, buildings and shapes on small worlds, some against sequential restatements."""

import random
from collections import Counter

import numpy as np
import pytest

from lattica.operators import blocks as B
from lattica.operators import buildings, encode, mesh, shapes, trees
from lattica.operators.graph import connected_components, reachable

WORLD = "x int, y int, z int, name string, prop string"


def as_world(spark, places):
    return spark.createDataFrame([(x, y, z, n, p) for (x, y, z), (n, p) in places.items()], WORLD)


def classes(pairs):
    """Sets of members from (member, label)."""
    found = {}
    for member, label in pairs:
        found.setdefault(label, set()).add(member)
    return sorted(map(sorted, found.values()))


# --- blocks --------------------------------------------------------------------------------------


def test_filters(spark):
    rows = as_world(spark, {(x, y, 0): (n, "None") for x, (y, n) in enumerate([(0, "air"), (1, "chair"), (2, "stone"), (3, "cave_air"), (4, "oak_log")])})
    assert {r.name for r in B.without_air(rows).collect()} == {"stone", "oak_log"}
    assert {r.name for r in B.without_air(rows, exact=True).collect()} == {"stone", "oak_log", "chair"}
    assert [r.y for r in B.clip_height(rows, 2, 4).orderBy("y").collect()] == [2, 3]
    assert B.search(rows, "'STONE' ").count() == 1
    with pytest.raises(LookupError):
        B.search(rows, "nothing", rows.select("name"))
    assert B.dump_lines(rows.where("y = 4")).first().line == "oak_log:None:4.4.0"


def test_clipping_at_chunk_edges(spark):
    rows = as_world(spark, {(x, 0, 0): ("stone", "None") for x in range(-20, 40)})
    xs = lambda lim, mode: sorted(r.x for r in B.clip_sides(rows, lim, (0, 15), mode).collect())
    assert xs((-5, 20), "reference") == list(range(-5, 20))
    assert xs((-5, 31), "reference") == list(range(-5, 32))
    assert xs((-5, 20), "inclusive") == list(range(-5, 21))
    with pytest.raises(ValueError):
        xs((0, 1), "other")


def test_dictionaries(spark):
    rows = as_world(spark, {(0, 0, 0): ("stone", "a=1"), (1, 0, 0): ("dirt", "None"), (2, 0, 0): ("stone", "None")})
    names = encode.dictionary(rows, "name")
    assert sorted(map(tuple, names.collect())) == [(0, "dirt"), (1, "stone")]
    assert sorted(map(tuple, encode.with_markers(names, "tree_marker", "stone").collect())) == [(0, "dirt"), (1, "stone"), (2, "tree_marker")]
    coded = spark.createDataFrame([(1, 0), (9, 0)], "id int, prop int")
    assert {(r.id, r.name) for r in encode.decoded(coded, names).collect()} == {(1, "stone"), (9, "other")}
    assert {r.name for r in encode.decoded(coded, names, missing="id").collect()} == {"stone", "unknown_9"}


# --- meshes --------------------------------------------------------------------------------------


def test_cube(spark):
    cube = as_world(spark, {(x, y, z): ("stone", "None") for x in range(3) for y in range(3) for z in range(3)})
    quads = mesh.faces(cube).withColumn("material", mesh.F.lit("other"))
    corner = mesh.vertices(quads)
    assert quads.count() == 54 and sorted(r.vid for r in corner.collect()) == list(range(1, 57))
    assert mesh.triangles(quads).count() == 108
    lines = mesh.obj_lines(corner, mesh.indexed(quads, corner, "material"), "a.mtl").orderBy("part", "name", "k").collect()
    assert lines[0].line == "mtllib a.mtl" and lines[1].line == "v 0 0 0" and len(lines) == 1 + 56 + 1 + 54


def test_meshes_are_closed(spark):
    rng = random.Random(2)
    places = {p: ("stone", "None") for p in {(rng.randint(0, 5), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(90)}}
    edges, normals = Counter(), Counter()
    for f in mesh.faces(as_world(spark, places)).collect():
        assert (f.x + f.dx, f.y + f.dy, f.z + f.dz) not in places
        corners = [tuple(c) for c in f.corners]
        edges.update(frozenset(e) for e in zip(corners, corners[1:] + corners[:1]))
        normals[f.dx, f.dy, f.dz] += 1
    assert all(n % 2 == 0 for n in edges.values())
    assert all(normals[n] == normals[tuple(-v for v in n)] for n in normals)


# --- graphs --------------------------------------------------------------------------------------


def test_components_and_reach(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(300, 300), (None, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {r.node: r.component for r in connected_components(df).collect()} == {a: find(a) for a in root}
    seen, todo = {3, 230}, [3, 230]
    while todo:
        a = todo.pop()
        for u, v in edges:
            if u == a and v not in seen:
                seen.add(v)
                todo.append(v)
    seeds = spark.createDataFrame([(3,), (230,), (None,)], "node long")
    assert {r.node for r in reachable(seeds, df).collect()} == seen


# --- trees ---------------------------------------------------------------------------------------


def test_adoption_is_by_first_claim():
    upper = {(0, 0): (1, True), (0, 2): (1, True), (5, 5): (2, True), (9, 9): (1, False)}
    lower = {(0, 0): (1, False, False), (0, 1): (1, False, False), (1, 1): (1, False, False), (2, 1): (1, True, True), (5, 5): (1, False, False), (9, 9): (1, False, False)}
    got = trees.adopt(upper, lower, guarded=True)
    assert {((0, 0), (0, 0)), ((0, 0), (0, 1)), ((0, 0), (1, 1))} <= set(got) and not any(a == (0, 2) for a, _ in got)
    assert ((0, 0), (2, 1)) not in got and not any(b in ((5, 5), (9, 9)) for _, b in got)
    assert ((0, 0), (2, 1)) in trees.adopt(upper, lower, guarded=False)


def test_trees_leave_the_world(spark):
    places = {(x, 0, z): ("grass_block", "None") for x in range(-2, 14) for z in range(-2, 6)}
    trunk = {(0, y, 0): ("oak_log", "axis=y") for y in range(1, 6)}
    crown = {(x, y, z): ("oak_leaves", "None") for x in (-1, 0, 1) for y in (4, 5, 6) for z in (-1, 0, 1)}
    alone = {(10, y, 0): ("oak_log", "axis=y") for y in (1, 2)}
    loose = {(30, 9, 30): ("birch_leaves", "None"), (31, 9, 30): ("birch_leaves", "None")}
    near = {(2, 7, 2): ("birch_leaves", "None")}  # touches the crown at a corner
    world = places | crown | trunk | alone | loose | near
    for exact in (True, False):
        got = {(r.x, r.y, r.z): r.name for r in trees.remove_trees(as_world(spark, world), exact).collect()}
        want = {p: n for p, (n, _) in (places | alone).items()} | {(0, 1, 0): "tree_marker"} | {p: "foliage_marker" for p in loose}
        assert got == want
    empty = as_world(spark, {(0, 0, 0): ("stone", "None")})
    assert [r.name for r in trees.remove_trees(empty).collect()] == ["stone"]


# --- shapes --------------------------------------------------------------------------------------


def drawn(box_x, box_z, d_x, d_z, mirror):
    """A grid with an upright L, one empty cell around it, mirrored."""
    w, h = box_x + d_x, box_z + d_z
    grid = np.zeros((w, h), bool)
    grid[1 : box_x - 1, 1 : h - 1] = True
    grid[1 : w - 1, d_z + 1 : h - 1] = True
    return grid[:: -1 if mirror[0] else 1, :: -1 if mirror[1] else 1]


@pytest.mark.parametrize("mirror", shapes.ORIENTATIONS)
def test_every_l_is_found(mirror):
    for box_x in (3, 4):
        for box_z in (3, 5):
            for d_x in (1, 2, 3):
                for d_z in (1, 3):
                    grid = drawn(box_x, box_z, d_x, d_z, mirror)
                    plane = shapes.Plane(grid, np.zeros_like(grid))
                    assert shapes.find_l(plane, 1, 1, mirror) == (box_x, box_z, d_x, d_z)
                    assert shapes.inside_cells(plane, 1, 1, (box_x, box_z, d_x, d_z), mirror) == set(zip(*np.nonzero(grid)))
                    over = shapes.Plane(grid, grid)  # something below
                    assert shapes.find_l(over, 1, 1, mirror) is None


def test_squares():
    for n in (1, 2, 4):
        grid = np.zeros((8, 8), bool)
        grid[2 : 2 + n, 3 : 3 + n] = True
        plane = shapes.Plane(grid, np.zeros_like(grid))
        assert [(i, j) for i in range(8) for j in range(8) if shapes.is_square(plane, i, j)] == [(2, 3)]
        assert not shapes.l_cells(plane, [(2, 3)])


# --- buildings -----------------------------------------------------------------------------------


def sequential_search(world):
    """place -> component: the search one seed after another. world: place -> is_natural."""
    claimed = {}
    for seed in sorted((p for p, natural in world.items() if not natural), key=lambda p: (-p[1], p[0], p[2])):
        if seed in claimed:
            continue
        layer, y = [seed], seed[1]
        while layer:
            own = []
            for p in layer:
                if p not in claimed:
                    claimed[p] = seed
                    own.append(p)
            stack = [p for p in own if not world[p]]
            while stack:
                x, _, z = stack.pop()
                for q in ((x + a, y, z + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if q in world and not world[q] and q not in claimed:
                        claimed[q] = seed
                        own.append(q)
                        stack.append(q)
            y -= 1
            layer = sorted({q for x, _, z in own for q in ((x + a, y, z + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in world})
            if all(world[q] for q in layer):
                break
    return claimed


def test_search_is_that_of_one_seed_after_another(spark):
    rng = random.Random(5)
    world = {}
    for copy in range(12):  # far from each other, so as many worlds in one run
        fill, natural = rng.choice((0.3, 0.5, 0.8)), rng.choice((0.4, 0.7, 0.9))
        world |= {(100 * copy + x, y, z): rng.random() < natural for x in range(7) for y in range(4) for z in range(6) if rng.random() < fill}
    df = spark.createDataFrame([(*p, n) for p, n in world.items()], "x int, y int, z int, is_natural boolean")
    got = buildings.raw_components(df).collect()
    assert len(got) == len({(r.x, r.y, r.z) for r in got})
    assert classes(((r.x, r.y, r.z), r.comp) for r in got) == classes(sequential_search(world).items())


def test_buildings_are_discarded_and_merged(spark):
    house = lambda x, name, size=3: {(x + a, 5, b): (name, "None") for a in range(size) for b in range(size)}
    world = house(0, "oak_planks") | {(3, 5, 1): ("stone", "None")} | house(4, "cobblestone")  # one natural block between
    world |= house(20, "oak_planks") | {(23, 5, 1): ("stone", "None"), (24, 5, 1): ("stone", "None")} | house(25, "oak_planks")  # two
    world |= house(40, "sandstone") | house(50, "oak_planks", 2) | house(60, "sandstone") | {(61, 6, 1): ("glass", "None")}
    found = buildings.find_buildings(as_world(spark, world)).collect()
    ids = {(r.x, r.y, r.z): r.building_id for r in found}
    assert ids[0, 5, 0] == ids[4, 5, 0] == ids[3, 5, 1] and ids[20, 5, 0] != ids[25, 5, 0]
    assert (23, 5, 1) not in ids and (40, 5, 0) not in ids and (50, 5, 0) not in ids and (60, 5, 0) in ids
    assert sorted(set(ids.values())) == list(range(4)) and {(r.x, r.y, r.z) for r in found if r.absorbed} == {(3, 5, 1)}
    assert buildings.find_buildings(as_world(spark, {(0, 0, 0): ("stone", "None")})).count() == 0


def test_reach_that_stops_short_is_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(25)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError):
        reachable(seeds, path, max_rounds=5)
    assert {r.node for r in reachable(seeds, path).collect()} == set(range(26))  # past the round in which tables are put together
