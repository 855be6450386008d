"""Reach in few rounds, and planes whose memory goes with their cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import graph, shapes


@pytest.mark.parametrize("seed", range(3))
def test_reach_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    edges += [(b, a) for a, b in edges if rng.random() < 0.5] + [(None, 4), (5, None)]
    seeds = rng.sample(range(70), 4)
    reached, line = set(seeds), list(seeds)
    while line:
        a = line.pop()
        for x, y in edges:
            if x == a and y is not None and y not in reached:
                reached.add(y)
                line.append(y)
    got = graph.reachable(spark.createDataFrame([(s,) for s in [*seeds, None, seeds[0]]], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(r.node for r in got.collect()) == sorted(reached)


def test_a_long_log_in_few_rounds(spark, monkeypatch):
    """10,000 blocks in a row that lead both ways, then two that lead one way."""
    names, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or stored(df, name))
    line = spark.range(9_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = line.unionByName(line.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(spark.createDataFrame([(9_999, 20_000), (20_000, 20_001), (30_000, 0)], "a long, b long"))
    got = graph.reachable(spark.createDataFrame([(5_000,)], "node long"), edges, src="a", dst="b")
    assert got.count() == 10_002 and got.where("node = 30000").isEmpty()
    assert len(names) < 30


def test_a_wide_plane_holds_its_cells_alone():
    """An L in a grid of 10 ** 12 places."""
    cells = np.array([(x, z) for x in range(5) for z in range(3)] + [(x, z) for x in range(2) for z in range(3, 8)]) + 500_000
    plane = shapes.Plane.of_cells(cells, cells, (1_000_000, 1_000_000))
    found = shapes.l_cells(plane, [(500_000, 500_000)])
    assert found == set(map(tuple, cells.tolist())) and not shapes.is_square(plane, 500_000, 500_000)
    square = np.array([(x, z) for x in range(300) for z in range(300)])
    assert shapes.is_square(shapes.Plane.of_cells(square, square, (1_000_000, 1_000_000)), 0, 0)
