"""Operator 12 against all pairs."""

import random

import numpy as np
import pytest

from lattica.llm import negatives

NAMES = "vec_id long, embedding array<float>, label int, cls int, v string, ids int, serve int, `to` int, mark long, score long"


def plain(rows, every, m):
    """All (anchor, positive, rank, negative, scores), from whole scores of all pairs."""
    kept = []
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((i, label, tuple(int(np.floor(float(np.float32(x)) * m.scale)) for x in e)))
    kept = list(dict.fromkeys(kept))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a)
        positives = [(-s, i) for s, i, label in scored if label == a[1]][: m.positives]
        for s, i in positives:
            found = [(-t, j) for t, j, label in scored if label != a[1] and m.low * s <= -m.high * t and -t <= s][: m.negatives]
            out += [(a[0], i, k + 1, j, s, t) for k, (t, j) in enumerate(found)]
    return sorted(out)


def vectors(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, spread) for x in c], rng.randrange(4)))
    return rows


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_all_negatives_with_any_number_of_pivots_and_parts(spark, spread):
    rng = random.Random(11)
    rows = vectors(rng, 500, 8, spread)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(60)]  # copies, many anchors among them
    rows += [(2000 + k, rows[4][1], k % 4) for k in range(20)]  # one vector, several labels
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6) for r in rows], NAMES).repartition(5)
    for m in (negatives.Mining(), negatives.Mining(pivots=3, rows_at_once=100, anchors_at_once=7), negatives.Mining(positives=2, negatives=9, low=50, pivots=8)):
        got = sorted(map(tuple, negatives.hard_negatives(df, 10, m).collect()))
        want = plain(rows, 10, m)
        assert want and got == want


def test_rows_that_take_no_part_and_odd_ones(spark):
    rng = random.Random(12)
    rows = vectors(rng, 120, 4, 0.5)
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (310, [1.0, None, 0.0, 0.0], 1), (320, [float("nan")] * 4, 1), (330, [float("inf"), 0.0, 0.0, 0.0], 1), (340, [1.0] * 4, None)]
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[11][1], rows[10][2]), (20, [0.0] * 4, 2), (350, [-1.0, -1.0], 1), (360, [], 2), (370, [0.5] * 6, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, negatives.hard_negatives(df, 10).collect()))
    assert got == plain(rows, 10, negatives.Mining())
    assert negatives.hard_negatives(df.where("false")).count() == 0
    assert negatives.hard_negatives(df.where("vec_id % 10 <> 0"), 10).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 30"), 10).count() == 0


def test_numbers_of_any_size(spark):
    rng = random.Random(13)
    for scale in (50.0, 1e5, 1e9):
        rows = [(i, [x * scale for x in e], label) for i, e, label in vectors(rng, 60, 3, 0.3)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        want = [r for r in plain(rows, 10, negatives.Mining())]
        got = sorted(map(tuple, negatives.hard_negatives(df, 10).collect()))
        if scale < 1e9:
            assert got == want
        else:  # scores beyond a long come back as the nearest one
            assert all(abs(s) < 1 << 63 for r in got for s in r[4:])
