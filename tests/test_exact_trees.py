"""Exact trees on a random world against layers scanned one after another, whole."""

import random

import numpy as np
import pytest

from lattica.operators import shapes, trees

CROSS = ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))
SIDES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def sequential_links(cells, same_variety=True):
    """Adoptions of every layer by the one above: places in scan order, each with its cross, each claim flooding on."""
    links = []
    for level in sorted({y for _, y, _ in cells}):
        low = {(x, z): c for (x, y, z), c in cells.items() if y == level - 1}
        free = set(low)
        for x, z in sorted((x, z) for x, y, z in cells if y == level):
            material, variety, axis = cells[x, level, z]
            if same_variety and material in ("log", "wood") and axis != "y":
                continue
            for dx, dz in CROSS:
                first = (x + dx, z + dz)
                if first not in free or same_variety and low[first][1] != variety:
                    continue
                free.discard(first)
                links.append(((x, level, z), (first[0], level - 1, first[1])))
                flood = [(x, z)]
                while flood:
                    at = flood.pop()
                    solid = at in low and at not in free and low[at][0] in ("log", "wood")
                    for step in ((-1, 0), (0, -1), (0, 1), (1, 0)):
                        near = (at[0] + step[0], at[1] + step[1])
                        if near not in free or same_variety and low[near][1] != variety:
                            continue
                        if same_variety and not solid and low[near][0] in ("log", "wood") and low[near][2] != "y":
                            continue
                        free.discard(near)
                        links.append(((x, level, z), (near[0], level - 1, near[1])))
                        flood.append(near)
    return links


def joined(places, links):
    root = {p: p for p in places}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a, b in links:
        root[find(a)] = find(b)
    return {p: find(p) for p in places}


def planar(cells, same_variety=True):
    return [((x, y, z), n) for (x, y, z), c in cells.items() for n in ((x + 1, y, z), (x, y, z + 1)) if n in cells and (not same_variety or cells[n][1] == c[1])]


def groups(label):
    found = {}
    for p, k in label.items():
        found.setdefault(k, set()).add(p)
    return sorted(map(sorted, found.values()))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(17)
    kinds = [("oak_log", "log", 0), ("oak_leaves", "leaf", 0), ("birch_leaves", "leaf", 2), ("birch_log", "log", 2), ("oak_wood", "wood", 0)]
    cells, rows = {}, []
    for x in range(11):
        for z in range(10):
            for y in range(6):
                if rng.random() < (0.5 if x < 6 else 0.3):
                    name, material, variety = rng.choice(kinds)
                    axis = rng.choice("xyyz") if material != "leaf" else None
                    cells[x, y, z] = material, variety, axis
                    rows.append((x, y, z, name, f"axis={axis}" if axis else "None"))
    # Framed squares and an L of logs, apart from the rest, and from one another.
    for x0, z0, shape in ((30, 0, [(a, b) for a in range(3) for b in range(3)]), (40, 0, [(a, b) for a in range(6) for b in range(2)] + [(a, b) for a in range(2) for b in range(2, 7)])):
        for a, b in shape:
            cells[x0 + a, 1, z0 + b] = "log", 0, "y"
            rows.append((x0 + a, 1, z0 + b, "oak_log", "axis=y"))
    df = spark.createDataFrame(rows, "x int, y int, z int, name string, prop string").repartition(3)
    return cells, trees.stored(trees.relevant(df), "random-cells")


@pytest.fixture(scope="module")
def found(world):
    return trees.stored(trees.components(world[1]), "random-trees")


def test_adoptions_and_trees(world, found):
    cells, table = world
    at = {r.node: (r.x, r.y, r.z) for r in table.collect()}
    links = sequential_links(cells)
    assert sorted((at[r.src], at[r.dst]) for r in trees.adoption_edges(table).collect()) == sorted(links)
    label = {(r.x, r.y, r.z): r.tree_id for r in found.collect()}
    assert groups(label) == groups(joined(cells, links + planar(cells)))
    least = {}
    for r in found.collect():
        least[r.tree_id] = min(r.node, least.get(r.tree_id, r.node))
    assert all(k == n for k, n in least.items())


def test_checks_of_exact_trees(world, found):
    cells = world[0]
    label = {(r.x, r.y, r.z): r.tree_id for r in found.collect()}
    logs = {p for p in cells if cells[p][0] in ("log", "wood")}
    seen = [p for p in logs if cells[p][0] == "wood" or cells[p][2] == "y"]
    reached = set(seen)
    while seen:
        x, y, z = seen.pop()
        for dx, dy, dz in SIDES:
            n = (x + dx, y + dy, z + dz)
            if n in logs and n not in reached and label[n] == label[x, y, z] and not (dy and cells[x, y, z][0] == "log" and cells[x, y, z][2] in "xz"):
                reached.add(n)
                seen.append(n)
    at = {r.node: (r.x, r.y, r.z) for r in found.collect()}
    assert {at[r.node] for r in trees.reached_logs(found).collect()} == reached and reached != logs

    squares, ls = set(), set()
    for k in set(label.values()):
        own = {p for p in label if label[p] == k}
        x0, z0 = min(x for x, _, _ in own), min(z for _, _, z in own)
        shape = max(x for x, _, _ in own) - x0 + 1, max(z for _, _, z in own) - z0 + 1
        for y in {y for _, y, _ in own}:
            filled, under = np.zeros(shape, bool), np.zeros(shape, bool)
            for x, v, z in own:
                if v == y:
                    filled[x - x0, z - z0] = True
                if v == y - 1:
                    under[x - x0, z - z0] = True
            plane = shapes.Plane(filled, under)
            for x, v, z in own & logs:
                if v == y:
                    i, j = x - x0, z - z0
                    square = any(filled[i : i + n, j : j + n].all() and filled[max(i - 1, 0) : i + n + 1, max(j - 1, 0) : j + n + 1].sum() == n * n for n in range(1, min(shape) - max(i, j) + 1))
                    if square:
                        squares.add((k, x, z))
                    for o in shapes.ORIENTATIONS:
                        if size := tried(plane, i, j, o):
                            if not square:
                                ls |= {(k, a + x0, b + z0) for a, b in shapes.inside_cells(plane, i, j, size, o)}
                            break
    assert {(r.tree_id, r.x, r.z) for r in trees.square_columns(found).collect()} == squares and len(squares) > 0
    assert {(r.tree_id, r.x, r.z) for r in trees.l_columns(found).collect()} == ls and len(ls) > 0


def test_orphans(world, found):
    cells = world[0]
    label = {(r.x, r.y, r.z): r.tree_id for r in found.collect()}
    kept = {}
    for k in set(label.values()):
        own = {p: cells[p] for p in label if label[p] == k}
        parts = groups(joined(own, sequential_links(own, False) + planar(own, False)))
        leafy = [p for p in parts if any(cells[c][0] == "leaf" for c in p)]
        for part in parts if len(parts) == 1 else leafy:
            kept |= {c: part[0] for c in part}
    got = {(r.x, r.y, r.z): r.tree_id for r in trees.split_orphans(found.where("material is not null")).collect()}
    assert groups(got) == groups(kept)


def tried(plane, i, j, orientation):
    """The first L that fits, all sizes tried in order."""
    n_x, n_z = plane.shape
    for box_z in range(3, n_z + 3 - j):
        for box_x in range(3, n_x + 3 - i):
            for d_z in range(n_z + 3 - box_z - j):
                for d_x in range(n_x + 3 - box_x - i):
                    empty, inside = shapes._rectangles(box_x, box_z, np.int64(d_x), np.int64(d_z))
                    place = lambda r: shapes._placed(r, i, j, box_x + d_x, box_z + d_z, *orientation)  # noqa: B023, E731
                    if all(plane.empty(*place(r)) for r in empty) and all(plane.solid(*place(r)) for r in inside):
                        return box_x, box_z, d_x, d_z
    return None


def test_sizes_follow_from_runs():
    rng = np.random.default_rng(0)
    seen = dict.fromkeys(shapes.ORIENTATIONS, 0)
    for k in range(40):
        w, h = rng.integers(2, 8, 2)
        filled = np.zeros((w, h), bool)
        for _ in range(rng.integers(1, 5) if k % 2 else 0):
            x, z = rng.integers(0, w), rng.integers(0, h)
            filled[x : x + rng.integers(1, 5), z : z + rng.integers(1, 5)] = True
        if k % 2 == 0:  # an L as such, the anchor in it or in its notch
            filled, size, o = np.zeros((9, 9), bool), tuple(int(n) for n in (*rng.integers(3, 5, 2), *rng.integers(2, 4, 2))), shapes.ORIENTATIONS[k // 2 % 4]
            for a, b in shapes.inside_cells(shapes.Plane(filled, filled), 1, 1, size, o):
                filled[a, b] = True
            filled[1, 1] = True
            filled[0, 1] |= o == (True, False)  # so that the cell in the notch is no square
        plane = shapes.Plane(filled, rng.random(filled.shape) < rng.choice([0, 0.05]))
        for i, j in zip(*np.nonzero(filled)) if k % 2 else [(1, 1)]:
            for o in shapes.ORIENTATIONS:
                want = tried(plane, int(i), int(j), o)
                assert shapes.find_l(plane, int(i), int(j), o) == want, (filled, i, j, o)
                seen[o] += want is not None and min(want[2:]) > 0
    assert min(seen.values()) > 0, seen
