"""Filters over blocks: air, height, horizontal clipping, chunk pruning, search by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import chunk_of

AIR = ("air", "cave_air", "void_air")


def without_air(blocks: DataFrame, exact: bool = False) -> DataFrame:
    """Drops names that end in air; only the three names of air itself if exact."""
    return blocks.where(~F.col("name").isin(*AIR) if exact else ~F.endswith("name", F.lit("air")))


def clip_height(blocks: DataFrame, low: int, high: int) -> DataFrame:
    """Keeps low <= y < high."""
    return blocks.where((F.col("y") >= low) & (F.col("y") < high))


def _side(c: str, low: int, high: int, mode: str) -> Column:
    if mode == "inclusive":
        return F.col(c).between(low, high)
    if mode != "reference":
        raise ValueError(f"clip mode {mode}: reference or inclusive")
    # The upper limit counts only where it is the last place of its chunk.
    return (F.col(c) >= low) & (F.col(c) < high + (high % 16 == 15))


def clip_sides(blocks: DataFrame, x: tuple[int, int], z: tuple[int, int], mode: str = "reference") -> DataFrame:
    """Keeps blocks within x and z limits: both ends (inclusive), or without the upper end unless it ends a chunk (reference)."""
    return blocks.where(_side("x", *x, mode) & _side("z", *z, mode))


def chunks_within(blocks: DataFrame, x: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """Keeps blocks of chunks that overlap the limits: the coarse test that prunes files partitioned by chunk."""
    cx, cz = chunk_of(F.col("x")), chunk_of(F.col("z"))
    return blocks.where(cx.between(x[0] // 16, x[1] // 16) & cz.between(z[0] // 16, z[1] // 16))


def chunk_counts(blocks: DataFrame) -> DataFrame:
    """(cx, cz, n): blocks of each chunk."""
    return blocks.groupBy(chunk_of(F.col("x")).alias("cx"), chunk_of(F.col("z")).alias("cz")).agg(F.count("*").alias("n"))


def search(blocks: DataFrame, query: str, names: DataFrame | None = None) -> DataFrame:
    """Blocks of one name, given with or without quotes and in any case. names: the dictionary that must hold the name."""
    wanted = query.strip().strip("\"'").lower()
    if names is not None and names.where(F.col("name") == wanted).isEmpty():
        raise LookupError(f"no block is named {wanted}")
    return blocks.where(F.col("name") == wanted)


def dump_lines(blocks: DataFrame, namespace: bool = False, properties: bool = True) -> DataFrame:
    """(line): a block in one line, in the four forms with or without namespace and properties."""
    parts = [F.col("ns")] * namespace + [F.col("name")] + [F.col("prop")] * properties
    place = F.format_string("%d.%d.%d", "x", "y", "z")
    return blocks.select(F.concat_ws(":", *parts, place).alias("line"))


def extents(blocks: DataFrame) -> DataFrame:
    """One row: the least and greatest x, y, z and the number of blocks."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return blocks.agg(*ends, F.count("*").alias("n"))


def last_wins(blocks: DataFrame, *order: str) -> DataFrame:
    """One row per place: that with the greatest order columns."""
    rest = [c for c in blocks.columns if c not in "xyz"]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return blocks.groupBy("x", "y", "z").agg(best).select("x", "y", "z", *[F.col(f"_b.{c}").alias(c) for c in rest])
