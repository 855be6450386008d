"""Adoptions that lie within a tile are settled at once; only what crosses a tile's sides is gone over again."""

import random

import pytest
from pyspark.sql import types as T

from lattica.operators import trees

from test_tiles import in_sequence

SCHEMA = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "z", "variety")] + [T.StructField(c, T.StringType()) for c in ("material", "axis")])


def node(x, y, z):
    return (x << 38) + (z + (1 << 25) << 12) + y + (1 << 11)


def wanted(cells, guarded):
    found = set()
    for level in {c[1] for c in cells}:
        is_flat = {c: guarded and material in ("log", "wood") and axis != "y" for c, (_, material, axis) in cells.items()}
        kind = lambda v: v if guarded else 0
        upper = {(x, z): (kind(v[0]), not is_flat[x, y, z]) for (x, y, z), v in cells.items() if y == level}
        lower = {(x, z): (kind(v[0]), is_flat[x, y, z], v[1] in ("log", "wood")) for (x, y, z), v in cells.items() if y == level - 1}
        found |= {(node(u[0], level, u[1]), node(at[0], level - 1, at[1])) for u, at in in_sequence(upper, lower, guarded)}
    return found


@pytest.mark.parametrize("seed, guarded", [(1, True), (2, True), (3, False)])
def test_layers_in_small_tiles_agree_with_the_sequence(spark, monkeypatch, seed, guarded):
    monkeypatch.setattr(trees, "TILE_SIDE", 5)
    seen, settled = [], trees.settled

    def watched(cells, *rest):
        seen.append(cells.where("not is_upper and inside").count())
        return settled(cells, *rest)

    monkeypatch.setattr(trees, "settled", watched)
    rng = random.Random(seed)
    places = [(x, y, z) for x in range(-8, 11) for y in range(4) for z in range(-9, 9)]
    cells = {p: (rng.randrange(3 if guarded else 1), rng.choice(("log", "wood", "leaf", "leaf")), rng.choice("xyz")) for p in places if rng.random() < (0.6 if guarded else 0.25)}
    df = spark.createDataFrame([(*p, *v) for p, v in cells.items()], SCHEMA)
    got = [tuple(r) for r in trees.adoption_edges(df, same_variety=guarded).select("src", "dst").collect()]
    assert sorted(got) == sorted(wanted(cells, guarded))
    assert 0 < seen[0] < 0.75 * len(cells)


def test_what_lies_within_a_tile_takes_no_rounds(spark, monkeypatch):
    """Crowns in the middle of tiles, and one across a side: only that one is left for rounds."""
    left, settled = [], trees.settled

    def watched(cells, *rest):
        left.extend(r.x for r in cells.where("inside").collect())
        return settled(cells, *rest)

    monkeypatch.setattr(trees, "settled", watched)
    middles = [64 + 128 * k for k in range(-2, 3)] + [128]
    rows = [(m, 1, 60, 0, "log", "y") for m in middles] + [(m + d, 0, 60, 0, "leaf", None) for m in middles for d in (-1, 0, 1)]
    got = {tuple(r) for r in trees.adoption_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(node(m, 1, 60), node(m + d, 0, 60)) for m in middles for d in (-1, 0, 1)}
    assert sorted(set(left)) == [127, 128, 129]
