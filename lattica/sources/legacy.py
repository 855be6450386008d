"""Older text forms of block tables: a block per line, and orders of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import order as orders

_LINE = r"^(?:(-?\d+):)?(-?\d+):(-?\d*):(-?\d+)\.(-?\d+)\.(-?\d+)\r?$"


def parsed(lines: DataFrame) -> DataFrame:
    """(ns, id, prop, x, y, z) from lines (value) id:prop:x.y.z, with a namespace before them or not; an empty prop is -1. Others drop out."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    rows = lines.where(F.col("value").rlike(_LINE))
    number = lambda c: F.when(c != "", c.cast("int"))
    return rows.select(number(part(1)).alias("ns"), part(2).cast("int").alias("id"), F.coalesce(number(part(3)), F.lit(-1)).alias("prop"), *[part(k).cast("int").alias(c) for k, c in ((4, "x"), (5, "y"), (6, "z"))])


def malformed(lines: DataFrame) -> DataFrame:
    return lines.where(~F.coalesce(F.col("value").rlike(_LINE), F.lit(False)))


def formatted(blocks: DataFrame) -> DataFrame:
    """(value): blocks' lines; prop -1 becomes empty, a null namespace is left out."""
    prop = F.when(F.col("prop") == -1, "").otherwise(F.col("prop").cast("string"))
    body = F.concat_ws(":", F.col("id"), prop, F.concat_ws(".", "x", "y", "z"))
    return blocks.select((F.when(F.col("ns").isNotNull(), F.concat(F.col("ns"), F.lit(":"), body)).otherwise(body) if "ns" in blocks.columns else body).alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """(line_no, value): lines read by spark.read.text, numbered in file order within each file."""
    return lines.select(F.monotonically_increasing_id().alias("line_no"), "value")


def ranked(rows: DataFrame, key: str, descending: bool, order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in the order of key (from the greatest down if descending), then of the columns order.

    A minus sign before a column of order turns it.
    """
    turned = lambda c: F.desc(c[1:]) if c.startswith("-") else F.asc(c)
    return orders.numbered(rows, [F.desc(key) if descending else F.asc(key), *map(turned, order)], name, 1)


def sorted_by_height(lines: DataFrame) -> DataFrame:
    """(line_no, value, place): from the highest y down, lines of one height in their order."""
    height = F.regexp_extract("value", r"\.(-?\d+)\.-?\d+\r?$", 1).cast("int")
    rows = lines.withColumn("height", height)
    return ranked(rows, "height", True, ["line_no"], "place").drop("height")


def reversed_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value, place): the last line first."""
    return ranked(lines, "line_no", True, [], "place")
