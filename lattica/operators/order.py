"""Numbers in an order that no task has to hold as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import fresh
from ..functions.storage import stored

_BITS = 33  # of a row's place in its partition, in monotonically_increasing_id


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """rows with their place in an order, from first on, in column name.

    Ranges of the whole order are sorted apart and written to the shared folder; a range's rows are numbered by their place
    in it, after the counts of the ranges before. Rows that are equal in the order are numbered in any.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, size, before = fresh(rows, "_place", "_range", "_n", "_before")
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = stored(placed, "numbered").withColumn(part, F.shiftright(place, _BITS))
    sizes = placed.groupBy(part).agg(F.count("*").alias(size))
    starts = sizes.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))  # a row per range
    within = F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(before) + within + first).drop(place, part, before)
