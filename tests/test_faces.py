"""Faces by cubes against a look at each neighbour."""

import random

import pytest

from lattica.operators import neighbors


@pytest.mark.parametrize("side", [1, 2, 5, 32])
def test_faces_in_cubes_of_any_size(spark, monkeypatch, side):
    monkeypatch.setattr(neighbors, "SIDE", side)
    rng = random.Random(side)
    places = [(x, y, z) for x in range(-6, 5) for y in range(-3, 4) for z in range(-4, 6)]
    rows = [(*p, f"n{k}", rng.randrange(2), [k], k) for k, p in enumerate(rng.sample(places, 400))]
    df = spark.createDataFrame([*rows, (None, 0, 0, "nowhere", 0, [0], -1)], "x int, y int, z int, name string, building_id int, `row` array<int>, c0 int").repartition(3)
    held = {r[:3]: r for r in rows}
    near = lambda r, d: tuple(a + b for a, b in zip(r[:3], d, strict=True))
    got = neighbors.exposed(df)
    assert got.columns == [*df.columns, "dx", "dy", "dz"]
    assert sorted(map(tuple, got.collect())) == sorted((*r, *d) for r in rows for d in neighbors.SIDES6 if near(r, d) not in held)
    got = neighbors.exposed(df, within=("building_id",))
    assert sorted(map(tuple, got.collect())) == sorted((*r, *d) for r in rows for d in neighbors.SIDES6 if held.get(near(r, d), (0,) * 4 + (9,))[4] != r[4])
    some = {r[:3] for r in rows if r[6] % 3 == 0}
    got = neighbors.exposed(df, df.where("c0 % 3 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted((*r, *d) for r in rows for d in neighbors.SIDES6 if near(r, d) not in some)
    assert neighbors.exposed(df.where("false")).count() == 0
