"""Work that goes through a world in order, cut into tiles that settle what crosses their edges by what they say to one another.

A tile is worked on by one task. What it does depends on earlier steps in other tiles only through what these say, so tiles are
worked on anew with what reaches them now, until nothing else reaches any of them than before. Each step depends on earlier ones
alone, hence tiles that stand still agree with the sequence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Cells along a tile's side.
SIDE = 128
#: What a tile says, and what reaches one.
FACTS, INBOX = "sender long, what int, a long, b long, body binary", "tile long, what int, a long, b long, body binary"

#: (tile, its cells, what reaches it) to what it says, a row (what, a, b, body) each, and its rows by column.
Look = Callable[[int, pa.Table, pa.Table], tuple[list[tuple], list[np.ndarray]]]


def tile_of(x: Column, z: Column, level: Column, side: int = SIDE) -> Column:
    """The number of the tile of a place in a layer: as codec.packed, of the tile's own coordinates."""
    return F.floor(x / side).cast("long") * (1 << 38) + (F.floor(z / side).cast("long") + (1 << 25)) * (1 << 12) + (level.cast("long") + (1 << 11))


def tile_place(tile: int) -> tuple[int, int, int]:
    """x and z of a tile, in tiles, and its layer."""
    return tile >> 38, (tile >> 12 & (1 << 26) - 1) - (1 << 25), (tile & (1 << 12) - 1) - (1 << 11)


def tile_number(x: int, z: int, level: int) -> int:
    return (x << 38) + (z + (1 << 25) << 12) + level + (1 << 11)


def with_edges(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """cells (x, z, level) by tile, and those next to a tile's sides again for it; inside tells them apart."""
    near = [F.when(F.pmod(F.col(c), F.lit(side)) == at, F.struct(*[(F.lit(d) if c == k else F.lit(0)).alias(f"d{k}") for k in "xz"])) for c in "xz" for at, d in ((0, -side), (side - 1, side))]
    ways = F.filter(F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dz")), *near), lambda w: w.isNotNull())
    spread = cells.withColumn("_way", F.explode(ways))
    tile = tile_of(F.col("x") + F.col("_way.dx"), F.col("z") + F.col("_way.dz"), F.col("level"), side)
    return spread.withColumn("tile", tile).withColumn("inside", (F.col("_way.dx") == 0) & (F.col("_way.dz") == 0)).drop("_way")


def to_tiles(facts: DataFrame) -> DataFrame:
    """The inbox where a names the tile that is spoken to."""
    return facts.select(F.col("a").alias("tile"), "what", F.lit(None).cast("long").alias("a"), "b", "body")


def settled(cells: DataFrame, look: Look, schema: str, name: str, route: Callable[[DataFrame], DataFrame] = to_tiles, max_rounds: int = 1000) -> DataFrame:
    """Rows of schema (longs) that look gives for every tile of cells (column tile) once all that reaches a tile stands still.

    route turns what all tiles say (FACTS) into what reaches them (INBOX), in no order. Only tiles that something else reaches are
    worked on again; what they say and their rows are written to the shared folder each round.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c.split()[0] for c in schema.split(",")]
    kinds = [("sender", pa.int64()), ("what", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("body", pa.binary())]
    out_schema = pa.schema([*kinds, *[(c, pa.int64()) for c in columns]])

    def work(part: pa.Table, inbox: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.Table.from_batches([], schema=out_schema)
        tile = part.column("tile")[0].as_py()
        said, found = look(tile, part, inbox)
        m, k = len(said), len(found[0])
        facts = list(zip(*said, strict=True)) if said else [[]] * 4
        first = [pa.array([tile] * (m + k), pa.int64()), *[pa.concat_arrays([pa.array(f, t), pa.nulls(k, t)]) for f, (_, t) in zip(facts, kinds[1:], strict=True)]]
        rest = [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.asarray(f, np.int64))]) for f in found]
        return pa.Table.from_arrays([*first, *rest], schema=out_schema)

    def worked(which: DataFrame, inbox: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = which.repartition(n, "tile").groupBy("tile").cogroup(inbox.repartition(n, "tile").groupBy("tile")).applyInArrow(work, f"{FACTS}, {schema}")
        rows = stored(rows, f"{name}-worked")
        return rows.where("what is not null").select("sender", "what", "a", "b", "body"), rows.where("what is null").select("sender", *columns)

    cells = stored(cells, f"{name}-cells")
    said, found = worked(cells, cells.sparkSession.createDataFrame([], INBOX))
    rounds, known = [(None, found)], cells.sparkSession.createDataFrame([], "tile long, was decimal(38,0)")
    for _ in range(max_rounds):
        inbox, seen = stored(route(said), f"{name}-inbox"), Observation()
        now = inbox.groupBy("tile").agg(F.sum(F.xxhash64("what", "a", "b", "body").cast("decimal(38,0)")).alias("hash"))
        differs = now.join(known, "tile", "full").where("not (hash <=> was)").select("tile")
        changed = stored(differs.observe(seen, F.count("*").alias("n")), f"{name}-changed")
        if not seen.get["n"]:
            break
        fresh, found = worked(cells.join(changed, "tile", "left_semi"), inbox.join(changed, "tile", "left_semi"))
        senders = changed.withColumnRenamed("tile", "sender")
        rounds.append((senders, found))
        said, known = stored(said.join(senders, "sender", "left_anti").unionByName(fresh), f"{name}-said"), now.withColumnRenamed("hash", "was")
    else:
        raise RuntimeError(f"tiles did not settle in {max_rounds} rounds")
    out, later = None, None
    for senders, rows in reversed(rounds):
        valid = (rows if later is None else rows.join(later, "sender", "left_anti")).select(*columns)
        out = valid if out is None else out.unionByName(valid)
        later = senders if later is None else later if senders is None else later.unionByName(senders).distinct()
    return out
