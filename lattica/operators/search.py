"""The search for buildings within a tile of columns, from the top down.

A level's blocks look at the labels in the three by three places above them. A component that finds an unnatural block on a level is
alive there: it takes the planes that it reaches, if no earlier one does, and the natural blocks below it. What a tile needs of
others: labels beside its sides, the earliest component that reaches a plane which it shares with them, and whether a component
that is in several tiles is alive on a level. Each of these follows from the level above, so no two of them hold each other up.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import apart
from .tiles import tile_number, tile_place

#: What tiles say: labels for a tile beside, (plane, component) that reaches it, (component, level) alive, (component, level) asked for.
BESIDE, REACHES, ALIVE, ASKS = range(4)
NONE = np.iinfo(np.int64).max
AROUND = list(product((-1, 0, 1), repeat=2))
_LABEL = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("label", "<i8")])


def routed(facts: DataFrame, members: DataFrame) -> DataFrame:
    """What reaches each tile: labels as they were sent, the least component for planes that it shares, answers to what it asks.

    members: (plane, tile) of planes that lie in several tiles.
    """
    blank = F.lit(None).cast("binary").alias("body")
    beside = facts.where(F.col("what") == BESIDE).select(F.col("a").alias("tile"), "what", F.lit(None).cast("long").alias("a"), "b", "body")
    least = facts.where(F.col("what") == REACHES).groupBy(F.col("a").alias("plane")).agg(F.min("b").alias("b"))
    reached = members.join(apart(least), "plane").select("tile", F.lit(REACHES).alias("what"), F.col("plane").alias("a"), "b", blank)
    alive = facts.where(F.col("what") == ALIVE).select("a", "b").distinct()
    asked = facts.where(F.col("what") == ASKS).select(F.col("sender").alias("tile"), "a", "b")
    answers = asked.join(apart(alive), ["a", "b"]).select("tile", F.lit(ALIVE).alias("what"), "a", "b", blank)
    return beside.unionByName(reached).unionByName(answers)


def look(side: int):
    """For tiles.settled: (x, y, z, comp) of the blocks that components claim in a tile."""

    def work(tile: int, part: pa.Table, inbox: pa.Table) -> tuple[list[tuple], list[np.ndarray]]:
        tx, tz, _ = tile_place(tile)
        x, y, z = (part.column(c).to_numpy().astype(np.int64) for c in "xyz")
        order = np.argsort(-y, kind="stable")
        x, y, z = x[order], y[order], z[order]
        at_x, at_z = x - tx * side + 1, z - tz * side + 1
        plane, seed = (part.column(c).fill_null(NONE).to_numpy()[order] for c in ("plane", "seed"))
        shared = part.column("shared").fill_null(False).to_numpy(zero_copy_only=False)[order]
        natural = part.column("plane").is_null().to_numpy(zero_copy_only=False)[order]

        what, a, b = (inbox.column(c).fill_null(0).to_numpy() for c in ("what", "a", "b"))
        beside = np.concatenate([np.zeros(0, _LABEL), *[np.frombuffer(body, _LABEL) for body in inbox.column("body").to_pylist() if body is not None]])
        beside = beside[np.argsort(-beside["y"], kind="stable")]
        reached_by = dict(zip(a[what == REACHES].tolist(), b[what == REACHES].tolist(), strict=True))
        told: dict[int, list[int]] = {}
        for comp, level in zip(a[what == ALIVE].tolist(), b[what == ALIVE].tolist(), strict=True):
            told.setdefault(level, []).append(comp)

        def ring(grid: np.ndarray, level: int) -> np.ndarray:
            own = slice(*np.searchsorted(-beside["y"], [-level, -level + 1]))
            grid[beside["x"][own] - tx * side + 1, beside["z"][own] - tz * side + 1] = beside["label"][own]
            return grid

        empty = lambda: np.full((side + 2, side + 2), NONE, np.int64)
        comp = np.full(len(x), NONE, np.int64)
        reaches, alive, asks, roaming = [], [], [], [beside["label"]]
        begins = np.flatnonzero(np.diff(y, prepend=NONE)) if len(y) else np.zeros(0, np.int64)
        last, above = None, None
        for first, end in zip(begins.tolist(), [*begins[1:].tolist(), len(y)], strict=True):
            level = int(y[first])
            if last != level + 1:
                above = ring(empty(), level + 1)
            here = slice(first, end)
            near = np.stack([above[at_x[here] + i, at_z[here] + j] for i, j in AROUND])
            wild = natural[here]
            lives = np.unique(near[:, ~wild])
            lives = lives[lives < NONE]
            alive.append((lives, level))
            if not wild.all():
                names, of = np.unique(plane[here][~wild], return_inverse=True)
                least = np.full(len(names), NONE, np.int64)
                np.minimum.at(least, of, near[:, ~wild].min(0))
                some = np.zeros(len(names), bool)
                some[of] = shared[here][~wild]
                for k in np.flatnonzero(some).tolist():
                    if least[k] < NONE:
                        reaches.append((REACHES, int(names[k]), int(least[k]), None))
                    least[k] = min(least[k], reached_by.get(int(names[k]), NONE))
                own = np.minimum(least[of], NONE)
                comp[np.flatnonzero(~wild) + first] = np.where(own < NONE, own, seed[here][~wild])
                roaming.append(comp[here][~wild][shared[here][~wild]])
            if wild.any():
                over = near[:, wild]
                living = np.isin(over, np.concatenate((lives, np.array(told.get(level, []), np.int64))))
                comp[np.flatnonzero(wild) + first] = np.where(living, over, NONE).min(0)
                unsure = np.unique(over)
                asks.append((unsure[(unsure < NONE) & ~np.isin(unsure, lives)], level))
            above, last = ring(empty(), level), level
            above[at_x[here], at_z[here]] = comp[here]

        claimed = comp < NONE
        said = []
        for i, j in AROUND:
            if i or j:
                edge = claimed & (np.ones(len(x), bool) if not i else at_x == (1 if i < 0 else side)) & (np.ones(len(x), bool) if not j else at_z == (1 if j < 0 else side))
                if edge.any():
                    body = np.empty(int(edge.sum()), _LABEL)
                    for name, values in (("x", x), ("y", y), ("z", z), ("label", comp)):
                        body[name] = values[edge]
                    said.append((BESIDE, tile_number(tx + i, tz + j, 0), None, np.sort(body, order=["y", "x", "z"]).tobytes()))
                    roaming.append(comp[edge])
        wander = np.unique(np.concatenate(roaming))
        said += reaches
        for what_, found in ((ALIVE, alive), (ASKS, asks)):
            said += [(what_, c, level, None) for comps, level in found for c in comps[np.isin(comps, wander)].tolist()]
        return said, [x[claimed], y[claimed], z[claimed], comp[claimed]]

    return work
