"""L shapes and squares of filled cells in a plane, by runs of cells and counts along lines.

An L is a corner box and up to two arms, filled inside and framed by empty cells one wide; cells beyond the grid hold
anything. The four orientations are mirror images within the L's bounding rectangle. Inside cells must also have nothing
below them. Of the sizes that fit, the least is the result (by box z, box x, arm z, arm x).

Inside cells are solid and frames empty, so an L's sizes follow from runs of solid cells: along its long side to the frame
beyond, along its foot, and across the ends of both. Only the L whose notch is next to the anchor leaves one size open.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Mirrored along x, mirrored along z, in the order in which they are tried.
ORIENTATIONS = ((False, False), (True, False), (False, True), (True, True))


class _Lines:
    """Cells by one coordinate: of each line the other coordinate of its cells, ascending. Memory goes with the cells."""

    def __init__(self, line: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, line))
        line, self.at = line[order], at[order]
        self.names, begins = np.unique(line, return_index=True)
        self.begins = np.append(begins, len(line))
        self.place = {int(n): k for k, n in enumerate(self.names)}
        # Runs of neighbours on a line: the last cell of each, and the first.
        breaks = np.flatnonzero((np.diff(line) != 0) | (np.diff(self.at) != 1)) if len(line) else np.zeros(0, int)
        starts = np.concatenate(([0], breaks + 1))[: len(line)]
        ends = np.append(breaks, len(line) - 1)[: len(line)]
        run = np.cumsum(np.isin(np.arange(len(line)), starts)) - 1
        self.first, self.last = self.at[starts][run] if len(line) else self.at, self.at[ends][run] if len(line) else self.at

    def line(self, name: int) -> np.ndarray:
        k = self.place.get(name)
        return self.at[:0] if k is None else self.at[self.begins[k] : self.begins[k + 1]]

    def count(self, name: int, begin: int, end: int) -> int:
        own = self.line(name)
        return int(np.searchsorted(own, end) - np.searchsorted(own, begin)) if end > begin else 0

    def run(self, name: int, at: int) -> tuple[int, int]:
        """How many cells without a gap lie from one on, and up to it; none if it is not a cell."""
        k = self.place.get(name)
        if k is None:
            return 0, 0
        i = self.begins[k] + int(np.searchsorted(self.line(name), at))
        if i == self.begins[k + 1] or self.at[i] != at:
            return 0, 0
        return int(self.last[i]) - at + 1, at - int(self.first[i]) + 1

    def starts(self, name: int, after: int) -> list[int]:
        """Where runs begin on a line beyond a place."""
        own = self.line(name)
        k = self.place.get(name)
        return own[(self.first[self.begins[k] : self.begins[k + 1]] == own) & (own > after)].tolist() if k is not None else []


class Plane:
    """Filled cells (x, z) of a grid and those with something below. It holds cells, not the grid; of a few, a set too."""

    few: set[tuple[int, int]] | None = None

    def __init__(self, filled: np.ndarray, under: np.ndarray):
        self._set(np.argwhere(filled), np.argwhere(filled & ~under), filled.shape)

    @classmethod
    def of_cells(cls, filled: np.ndarray, solid: np.ndarray, shape: tuple[int, int]) -> Plane:
        """filled, and solid (those of them with nothing below): a row per cell."""
        plane = cls.__new__(cls)
        plane._set(filled, solid, shape)
        return plane

    @classmethod
    def of_few(cls, filled: set[tuple[int, int]], solid: set[tuple[int, int]], shape: tuple[int, int]) -> Plane:
        plane = cls.__new__(cls)
        plane._set(filled, solid, shape)
        plane.few = filled
        return plane

    def _set(self, filled, solid, shape: tuple[int, int]) -> None:
        self.shape, self._of = shape, (filled, solid)

    @cached_property
    def cells(self) -> list[tuple[_Lines, _Lines]]:
        """Filled and solid cells, by rows (x) and by columns (z)."""
        own = [np.array(sorted(c), np.int64).reshape(-1, 2) if isinstance(c, set) else c for c in self._of]
        return [(_Lines(c[:, 0], c[:, 1]), _Lines(c[:, 1], c[:, 0])) for c in own]

    def count(self, which: int, x0: int, z0: int, x1: int, z1: int) -> int:
        """Filled (0) or solid (1) cells with x0 <= x < x1 and z0 <= z < z1, along the rectangle's shorter side."""
        rows, columns = self.cells[which]
        if x1 - x0 <= z1 - z0:
            return sum(rows.count(x, z0, z1) for x in range(int(x0), int(x1)))
        return sum(columns.count(z, x0, x1) for z in range(int(z0), int(z1)))

    def empty(self, *r) -> bool:
        return self.count(0, *r) == 0

    def solid(self, x0, z0, x1, z1) -> bool:
        """Whether all cells of a rectangle that are on the grid are solid."""
        x0, x1, z0, z1 = max(0, int(x0)), min(self.shape[0], int(x1)), max(0, int(z0)), min(self.shape[1], int(z1))
        return x1 <= x0 or z1 <= z0 or self.count(1, x0, z0, x1, z1) == (x1 - x0) * (z1 - z0)

    def across(self, x: int, z: int) -> tuple[int, int]:
        """Solid cells from a cell on to greater x, and to lesser x."""
        return self.cells[1][1].run(z, x)

    def along(self, x: int, z: int) -> tuple[int, int]:
        """Solid cells from a cell on to greater z, and to lesser z."""
        return self.cells[1][0].run(x, z)


def _rectangles(box_x, box_z, d_x, d_z) -> tuple[list, list]:
    """Empty and inside rectangles (x0, z0, x1, z1) of an upright L in its bounding rectangle; arm sizes may be arrays."""
    w, h = box_x + d_x, box_z + d_z
    flat_x, flat_z = d_x == 0, d_z == 0
    empty = [
        (0, 0, 1, h),  # the long side
        (0, h - 1, w, h),  # the long foot
        (0, 0, np.where(flat_z, 0, box_x), 1),  # the arm's end
        (box_x - 1, 0, box_x, np.where(flat_x, h, d_z + 1)),  # the arm's side, with the inner corner
        (np.where(flat_x, w, w - 1), d_z, w, h),  # the foot's end
        (np.where(flat_z, 0, box_x), d_z, w, d_z + 1),  # the foot's upper side
    ]
    inside = [
        (1, 1, box_x - 1, d_z + 1),  # the arm, down to the row of the inner corner
        (1, np.where(flat_z, 1, d_z), box_x - 1, h - 1),  # the box under the arm
        (box_x - 1, d_z + 1, np.where(flat_x, box_x - 1, np.maximum(w - 1, box_x)), h - 1),  # the box's last column and the foot
    ]
    return empty, inside


def _placed(r, i, j, w, h, mirror_x, mirror_z):
    x0, z0, x1, z1 = r
    if mirror_x:
        x0, x1 = w - x1, w - x0
    if mirror_z:
        z0, z1 = h - z1, h - z0
    return x0 + i - 1, z0 + j - 1, x1 + i - 1, z1 + j - 1


def _fits(plane: Plane, i: int, j: int, size: tuple[int, int, int, int], orientation: tuple[bool, bool]) -> bool:
    box_x, box_z, d_x, d_z = size
    if box_x < 3 or box_z < 3 or d_x < 0 or d_z < 0:
        return False
    empty, inside = _rectangles(box_x, box_z, np.int64(d_x), np.int64(d_z))
    place = lambda r: _placed(r, i, j, box_x + d_x, box_z + d_z, *orientation)
    return all(plane.empty(*place(r)) for r in empty) and all(plane.solid(*place(r)) for r in inside)


def _sizes(plane: Plane, i: int, j: int, orientation: tuple[bool, bool]):
    """(box x, box z, whole x, whole z) of all Ls with a notch that may begin before (i, j)."""
    right, left = (lambda x, z: plane.across(x, z)[0]), (lambda x, z: plane.across(x, z)[1])
    down, up = (lambda x, z: plane.along(x, z)[0]), (lambda x, z: plane.along(x, z)[1])
    if orientation == (True, False):  # the notch is next to (i, j): the foot may begin anywhere below
        for z in plane.cells[1][0].starts(i, j):
            n = down(i, z)
            w = right(i, z + n - 1) + 2
            yield left(i + w - 3, j) + 2, n + 2, w, z - j + n + 2
        return
    mirror_x, mirror_z = orientation
    if not (right(i, j) and down(i, j)):
        return
    if not mirror_x and not mirror_z:
        h = down(i, j) + 2
        w = right(i, j + h - 3) + 2
        yield right(i, j) + 2, up(i + w - 3, j + h - 3) + 2, w, h
    elif mirror_z and not mirror_x:
        w, h = right(i, j) + 2, down(i, j) + 2
        yield right(i, j + h - 3) + 2, down(i + w - 3, j) + 2, w, h
    else:
        w = right(i, j) + 2
        h = down(i + w - 3, j) + 2
        yield left(i + w - 3, j + h - 3) + 2, down(i, j) + 2, w, h


def find_l(plane: Plane, i: int, j: int, orientation: tuple[bool, bool]) -> tuple[int, int, int, int] | None:
    """(box_x, box_z, d_x, d_z) of the least L of an orientation whose bounding rectangle begins before (i, j), or None."""
    found = [(bx, bz, w - bx, h - bz) for bx, bz, w, h in _sizes(plane, i, j, orientation)]
    w, h = plane.across(i, j)[0] + 2, plane.along(i, j)[0] + 2
    found += [(w, 3, 0, h - 3), (3, h, w - 3, 0)]  # a whole rectangle is an L with one arm or none
    fits = [s for s in found if _fits(plane, i, j, s, orientation)]
    return min(fits, key=lambda s: (s[1], s[0], s[3], s[2]), default=None)


def inside_cells(plane: Plane, i: int, j: int, size: tuple[int, int, int, int], orientation: tuple[bool, bool]) -> set[tuple[int, int]]:
    """Cells of the grid inside an L."""
    box_x, box_z, d_x, d_z = size
    found = set()
    for r in _rectangles(box_x, box_z, np.int64(d_x), np.int64(d_z))[1]:
        x0, z0, x1, z1 = (int(v) for v in _placed(r, i, j, box_x + d_x, box_z + d_z, *orientation))
        found |= {(x, z) for x in range(max(0, x0), min(plane.shape[0], x1)) for z in range(max(0, z0), min(plane.shape[1], z1))}
    return found


def is_square(plane: Plane, i: int, j: int) -> bool:
    """Whether an isolated filled square begins at (i, j): its side is the run of filled cells from there on."""
    if plane.few is not None:
        n = 0
        while (i + n, j) in plane.few:
            n += 1
    else:
        n = plane.cells[0][1].run(j, i)[0]
    if not 0 < n <= min(plane.shape) - max(i, j):
        return False
    if plane.few is not None:
        near = [(i <= x < i + n and j <= z < j + n) for x, z in plane.few if i - 1 <= x <= i + n and j - 1 <= z <= j + n]
        return len(near) == n * n and all(near)
    return plane.count(0, i, j, i + n, j + n) == n * n == plane.count(0, i - 1, j - 1, i + n + 1, j + n + 1)


def l_cells(plane: Plane, anchors: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Cells inside the Ls that begin at an anchor; squares are none."""
    found: set[tuple[int, int]] = set()
    for i, j in anchors:
        for orientation in ORIENTATIONS:
            if size := find_l(plane, i, j, orientation):
                if not is_square(plane, i, j):
                    found |= inside_cells(plane, i, j, size, orientation)
                break
    return found
