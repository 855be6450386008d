"""First claims between two layers, in scan order, tile by tile.

Places of the upper layer are taken in order of x and z. Each looks at the five places of its cross below, in order: one that is
free and of its kind is claimed, and a flood sets out from right under it, through free places of that kind. So a step has a
time: the place above, the place of its cross, and whether it is a claim in the cross or of the flood after it. A tile sends claims
and floods that leave it with their times, and when its places at the edge were claimed, if the neighbour's crosses reach them.

A flood may come back to a tile that it has left. Lest two tiles keep up each other's claims once what began them is gone, a flood
carries the places by which it entered tiles, and counts only where those of the tile itself are claimed by it.

Most claims have nothing to do with another tile: blocks that lie together, with those above that could claim them, mostly lie in
one. These are settled at once (parted), so only what crosses a tile's sides is gone over again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .graph import joined_up
from .tiles import SIDE, tile_number, tile_place

CROSS = ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))
SIDES = ((-1, 0), (0, -1), (0, 1), (1, 0))
CLAIM, STATUS = 0, 1
#: A tile's cells, and rows of parted.
CELLS = [("x", pa.int32()), ("z", pa.int32()), ("level", pa.int32()), ("is_upper", pa.bool_()), ("kind", pa.int64()), ("flat", pa.bool_()), ("wood", pa.bool_()), ("tile", pa.int64()), ("inside", pa.bool_())]
PARTED = pa.schema([("src", pa.int64()), ("dst", pa.int64()), *CELLS])
NEVER = (1 << 40, 0, 0)


class Tile:
    """The claims of a tile's upper places on its lower ones, given what other tiles send.

    upper: place -> (kind, adopts); lower: place -> (kind, is_flat, is_wood); both with the places next to the tile. If guarded,
    a flood does not pass from a leaf, or an empty place, to a log that lies flat.
    """

    def __init__(self, upper: dict, lower: dict, inside, guarded: bool):
        self.upper, self.lower, self.inside, self.guarded = upper, lower, inside, guarded
        self.claimed: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.sent: set[tuple] = set()  # messages: what, x and z of the place, the time's three numbers, passes, x and z of each entry

    def _flood(self, time: tuple[int, int, int], starts: list[tuple[tuple[int, int], bool]], path: tuple) -> None:
        """Claims from places that a flood has come to by path, each with whether it may pass to a flat log there."""
        lower, claimed, inside = self.lower, self.claimed, self.inside
        stack = []

        def reach(at, passes):
            if not inside(at):
                if passes or not lower[at][1]:
                    self.sent.add((CLAIM, *at, *time, int(passes), *path))
            elif at not in claimed and (passes or not lower[at][1]):
                claimed[at] = time
                stack.append(at)

        for at, passes in starts:
            reach(at, passes)
        while stack:
            a, b = stack.pop()
            kind, _, wood = lower[a, b]
            for i, j in SIDES:
                near = (a + i, b + j)
                if near in lower and lower[near][0] == kind:
                    reach(near, not self.guarded or wood)

    def _holds(self, time: tuple[int, int, int], path: tuple) -> bool:
        """Whether a flood has claimed the entries of its path that are this tile's."""
        return all(self.claimed.get(at) == time for at in zip(path[::2], path[1::2], strict=True) if self.inside(at))

    def run(self, messages: list[tuple]) -> None:
        lower, claimed = self.lower, self.claimed
        others: dict[tuple[int, int], tuple[int, int, int]] = {}
        came: dict[tuple[int, int], dict[int, list]] = {}
        for what, x, z, ux, uz, step, passes, *path in messages:
            if what == STATUS:
                others[x, z] = (ux, uz, step)
            else:
                came.setdefault((ux, uz), {}).setdefault(step, []).append((len(path), tuple(path), (x, z), bool(passes)))
        own = {u for u, (_, adopts) in self.upper.items() if adopts and self.inside(u)}
        for u in sorted(own | came.keys()):
            steps = came.get(u, {})
            kind = self.upper[u][0] if u in own else None
            for k, (i, j) in enumerate(CROSS):
                time, starts = (*u, 2 * k), []
                at = (u[0] + i, u[1] + j)
                if u in own and at in lower and lower[at][0] == kind:
                    is_own = self.inside(at)
                    if (at not in claimed) if is_own else others.get(at, NEVER) >= time:
                        if is_own:
                            claimed[at] = time
                        else:
                            self.sent.add((CLAIM, *at, *time, 0))
                        passes = not self.guarded or (u in claimed and lower[u][2])
                        starts = [(near, passes) for a, b in SIDES if (near := (u[0] + a, u[1] + b)) in lower and lower[near][0] == kind]
                for _, _, place, _ in steps.get(2 * k, ()):
                    claimed.setdefault(place, time)
                flood = (*u, 2 * k + 1)
                self._flood(flood, starts, ())
                for _, path, place, passes in sorted(steps.get(2 * k + 1, ())):
                    if self._holds(flood, path):
                        self._flood(flood, [(place, passes)], (*path, *place))

    def messages(self, level: int, side: int) -> dict[int, bytes]:
        """Bytes for each tile that is sent something."""
        rows: dict[int, set] = {}
        for row in self.sent:
            rows.setdefault(tile_number(row[1] // side, row[2] // side, level), set()).add(row)
        for u, (kind, adopts) in self.upper.items():
            if adopts and not self.inside(u):
                for i, j in SIDES:
                    at = (u[0] + i, u[1] + j)
                    if at in self.claimed and self.lower[at][0] == kind:
                        rows.setdefault(tile_number(u[0] // side, u[1] // side, level), set()).add((STATUS, *at, *self.claimed[at], 0))
        return {to: np.array([v for row in sorted(own) for v in (len(row), *row)], "<i4").tobytes() for to, own in rows.items()}


def unpacked(body: bytes) -> list[tuple]:
    """The rows of a message."""
    values, rows, at = np.frombuffer(body, "<i4").tolist(), [], 0
    while at < len(values):
        rows.append(tuple(values[at + 1 : at + 1 + values[at]]))
        at += 1 + values[at]
    return rows


def _nodes(places: list[tuple], y: int) -> np.ndarray:
    """codec.packed of places (x, z) of a layer."""
    p = np.array(places, np.int64).reshape(-1, 2)
    return (p[:, 0] << 38) + (p[:, 1] + (1 << 25) << 12) + y + (1 << 11)


def parted(guarded: bool, side: int = SIDE):
    """A tile's cells (with_edges) to PARTED: adoptions (src, dst) of what only this tile has to do with, and the cells that take more.

    Blocks hang together by whatever a step of the sequence may look at: lower ones of a kind side by side, upper ones with those of
    their cross, and, if guarded, with the place right below. What hangs together with nothing outside is whole here.
    """
    width = side + 3  # a free line beyond each side, so that no step leads round to the other

    def work(part: pa.Table) -> pa.Table:
        tx, tz, level = tile_place(part.column("tile")[0].as_py())
        x, z, kind, upper, flat, wood, inside = (part.column(c).to_numpy() for c in ("x", "z", "kind", "is_upper", "flat", "wood", "inside"))
        upper, flat, wood, inside = (c.astype(bool) for c in (upper, flat, wood, inside))
        place = (x.astype(np.int64) - tx * side + 1) * width + z - tz * side + 1
        _, last = np.unique((place + upper * width * width)[::-1], return_index=True)  # lower ones first; of a place that repeats, one
        rows = len(place) - 1 - last
        rows = rows[~(upper & flat)[rows]]
        n = int((~upper[rows]).sum())
        low, high, of = place[rows[:n]], place[rows[n:]], kind[rows]

        def met(own: np.ndarray, first: int, step: int, any_kind: bool = False) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(low, own + step)
            found = np.flatnonzero((np.append(low, -1)[at] == own + step) & (own + step >= 0))
            if not any_kind:
                found = found[of[found + first] == of[at[found]]]
            return found + first, at[found]

        links = [met(low, 0, step) for step in (1, width)] + [met(high, n, i * width + j, guarded and i == j == 0) for i, j in CROSS]
        nodes, roots = joined_up(*(np.concatenate(c) for c in zip(*links, strict=True)))
        _, group = np.unique(roots, return_inverse=True)
        own, others = (np.bincount(group, w) > 0 for w in (inside[rows[nodes]], ~inside[rows[nodes]]))
        cells, rest = rows[nodes[~others[group]]], rows[nodes[(own & others)[group]]]

        uppers, lowers = {}, {}
        for a, b, is_upper, k, lies, is_wood in zip(*(c[cells].tolist() for c in (x, z, upper, kind, flat, wood)), strict=True):
            if is_upper:
                uppers[a, b] = (k, True)
            else:
                lowers[a, b] = (k, lies, is_wood)
        whole = Tile(uppers, lowers, lambda at: True, guarded)
        whole.run([])
        src, dst = _nodes([u[:2] for u in whole.claimed.values()], level), _nodes(list(whole.claimed), level - 1)
        left = part.select([c for c, _ in CELLS]).take(pa.array(rest))
        found = pa.Table.from_arrays([pa.array(src), pa.array(dst), *[pa.nulls(len(src), t) for _, t in CELLS]], schema=PARTED)
        more = [pa.chunked_array([pa.nulls(len(rest), pa.int64())])] * 2 + [left.column(c).cast(t) for c, t in CELLS]
        return pa.concat_tables([found, pa.Table.from_arrays(more, schema=PARTED)])

    return work


def look(guarded: bool, side: int = SIDE):
    """For tiles.settled: (src, dst) of all adoptions of a tile's lower places."""

    def work(tile: int, part: pa.Table, inbox: pa.Table) -> tuple[list[tuple], list[np.ndarray]]:
        tx, tz, level = tile_place(tile)
        upper, lower = {}, {}
        of = {c: part.column(c).to_pylist() for c in ("x", "z", "is_upper", "kind", "flat", "wood")}
        for x, z, is_upper, kind, flat, wood in zip(*of.values(), strict=True):
            if is_upper:
                upper[x, z] = (kind, not flat)
            else:
                lower[x, z] = (kind, flat, wood)
        found = Tile(upper, lower, lambda p: p[0] // side == tx and p[1] // side == tz, guarded)
        found.run([row for body in inbox.column("body").to_pylist() for row in unpacked(body)])
        said = [(0, to, None, body) for to, body in found.messages(level, side).items()]
        return said, [_nodes([u[:2] for u in found.claimed.values()], level), _nodes(list(found.claimed), level - 1)]

    return work
