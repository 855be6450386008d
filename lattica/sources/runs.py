"""Run files: a command line and the answers to its questions, and the paths that follow from them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Run:
    command: str
    world: str
    dimension: str
    low: int
    high: int
    x: tuple[int, int] | None
    z: tuple[int, int] | None
    namespaces: bool

    @property
    def paths(self) -> dict[str, str]:
        """Names of what a run makes, from its world's folder name."""
        base = self.world.rstrip("\\/").replace("\\", "/").rsplit("/", 1)[-1]
        return {"blocks": f"{base}.world", "ids": f"{base}.blockIds", "properties": f"{base}.blockProperties", "trees": f"{base}_trees.world", "buildings": f"{base}_trees_buildings.world", "mesh": f"{base}_trees_buildings.obj"}


def dimension_of(folder: str) -> str:
    """overworld, nether or end, by a dimension's folder."""
    name = folder.strip().lower()
    if "dim-1" in name or "nether" in name:
        return "nether"
    return "end" if "dim1" in name or "the_end" in name or name.rstrip("\\/").endswith("end") else "overworld"


def parse_run(text: str) -> Run:
    """A run from a file's text; ValueError names all that is wrong.

    Line 1: > and a command. Then world, dimension, upper and lower height, whether all of the world counts (y or n), if
    not its x and z limits, and whether blocks have namespaces (y or n).
    """
    lines = [line.strip() for line in text.splitlines()]
    while lines and not lines[-1]:
        lines.pop()
    if not lines or not lines[0].startswith(">"):
        raise ValueError("the first line must begin with >")
    answers, wrong = lines[1:], []

    def number(k: int) -> int:
        try:
            return int(answers[k])
        except (ValueError, IndexError):
            wrong.append(f"answer {k + 1} must be a whole number")
            return 0

    def yes(k: int) -> bool:
        answer = answers[k].lower() if k < len(answers) else ""
        if answer not in ("y", "n"):
            wrong.append(f"answer {k + 1} must be y or n")
        return answer == "y"

    if len(answers) < 6:
        raise ValueError(f"only {len(answers)} answers")
    high, low, whole = number(2), number(3), yes(4)
    if high <= low:
        wrong.append("the upper height must be above the lower one")
    sides = [] if whole else [number(k) for k in range(5, 9)]
    spaces = yes(5 if whole else 9)
    if wrong:
        raise ValueError("; ".join(wrong))
    return Run(lines[0][1:].strip(), answers[0], dimension_of(answers[1]), low, high, None if whole else tuple(sides[:2]), None if whole else tuple(sides[2:]), spaces)


def run_order(names: list[str]) -> list[str]:
    """Names of runs in the order in which they go: those with extreme in them first, then by name."""
    return sorted(names, key=lambda n: ("extreme" not in n.lower(), n))
