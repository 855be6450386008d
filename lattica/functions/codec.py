"""Integer layouts of block files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_encoded(value: Column, width: int) -> Column:
    """Sign and magnitude in so many bytes: the top bit is the sign."""
    top = F.lit(1 << (8 * width - 1)).cast("long")
    return F.when(value < 0, F.abs(value).cast("long").bitwiseOR(top)).otherwise(value.cast("long"))


def sign_decoded(raw: Column, width: int) -> Column:
    top = F.lit(1 << (8 * width - 1)).cast("long")
    return F.when(raw.bitwiseAND(top) != 0, -(raw.bitwiseAND(top - 1))).otherwise(raw)


def coordinate_bytes(largest: int) -> int:
    """Bytes that hold magnitudes up to largest beside a sign, at least one."""
    return max(1, (int(largest).bit_length() + 1 + 7) // 8)


def code_bytes(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)


def inferred_widths(encoded: DataFrame) -> dict[str, int]:
    """Byte widths for (id, prop, x, y, z), from one aggregate. An empty table: one byte each."""
    row = encoded.agg(F.max(F.greatest("id", "prop")).alias("code"), *[F.max(F.abs(c)).alias(c) for c in "xyz"]).first()
    return {"code": code_bytes(row.code or 0)} | {c: coordinate_bytes(row[c] or 0) for c in "xyz"}


def packed(x: Column, y: Column, z: Column) -> Column:
    """x (26 bits with its sign), z (26 bits) and y (12 bits) in a long, as a node id that orders by x, z, y."""
    return x.cast("long") * (1 << 38) + (z.cast("long") + (1 << 25)) * (1 << 12) + (y.cast("long") + (1 << 11))


def unpacked(node: Column) -> tuple[Column, Column, Column]:
    x = F.shiftright(node, 38)
    z = F.shiftright(node, 12).bitwiseAND(F.lit((1 << 26) - 1).cast("long")) - (1 << 25)
    y = node.bitwiseAND(F.lit((1 << 12) - 1).cast("long")) - (1 << 11)
    return x.cast("int"), y.cast("int"), z.cast("int")


def local_of_index(index: Column, section: Column) -> tuple[Column, Column, Column]:
    """x, y and z within a chunk of a place in a 16x16x16 section: x is the fastest, then z, then y."""
    return index.bitwiseAND(15), F.shiftright(index, 8).bitwiseAND(15) + 16 * section, F.shiftright(index, 4).bitwiseAND(15)


def chunk_of(coordinate: Column) -> Column:
    return F.floor(coordinate / 16).cast("int")


def region_of(coordinate: Column) -> Column:
    return F.floor(coordinate / 512).cast("int")
