"""Neighbours on the lattice: offsets as a generator, then equi-joins on coordinates; for faces, cubes of places as grids of bits."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import apart

SIDES6 = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
PLANE4 = ((1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 0, -1))
PLANE8 = tuple((x, 0, z) for x, z in product((-1, 0, 1), repeat=2) if x or z)
CROSS5_BELOW = ((0, -1, 0), *((x, -1, z) for x, _, z in PLANE4))
SQUARE9_BELOW = tuple((x, -1, z) for x, z in product((-1, 0, 1), repeat=2))
ALL26 = tuple(o for o in product((-1, 0, 1), repeat=3) if any(o))
#: One of each two opposite directions, for relations that hold both ways.
HALF_PLANE4 = ((1, 0, 0), (0, 0, 1))
HALF_PLANE8 = ((1, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, -1))


#: Places along the side of a cube of which a task looks at all faces.
SIDE = 32


def stepped(blocks: DataFrame, offsets: tuple, prefix: str = "n") -> DataFrame:
    """A row per block and offset with the place (nx, ny, nz) that it leads to."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in offsets])
    spread = blocks.select("*", F.explode(steps).alias("_step"))
    return spread.select("*", *[(F.col(c) + F.col(f"_step.d{c}")).alias(f"{prefix}{c}") for c in "xyz"], F.col("_step.dx").alias("dx"), F.col("_step.dy").alias("dy"), F.col("_step.dz").alias("dz")).drop("_step")


def neighbors(blocks: DataFrame, others: DataFrame, offsets: tuple, how: str = "inner", keep: tuple[str, ...] = ()) -> DataFrame:
    """blocks, stepped by offsets, joined to others at the places stepped to; keep: columns of others, as n_<column>."""
    right = others.select(*[F.col(c).alias(f"n{c}") for c in "xyz"], *[F.col(c).alias(f"n_{c}") for c in keep])
    return stepped(blocks, offsets).join(apart(right), ["nx", "ny", "nz"], how)


def exposed(blocks: DataFrame, solid: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Faces (block, dx, dy, dz) behind which no solid block lies; within: columns without nulls that must be equal for one to count.

    Blocks go once to the cube of SIDE places a side that they lie in, and only places at its sides also to the cubes beside it; a task
    looks at a cube's neighbours as shifted grids of bits. Blocks without a place have no faces.
    """
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, place = [f"c{c}" for c in "xyz"], F.expr("x is not null and y is not null and z is not null")
    marks = [f"w{k}" for k in range(len(within))]
    cube = lambda x, y, z: [F.floor(v / SIDE).cast("int").alias(k) for v, k in zip((x, y, z), keys, strict=True)]
    apart = [F.col(f"`{c}`").alias(m) for c, m in zip(within, marks, strict=True)]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(blocks.columns)])
    own = blocks.where(place).select(*cube(*map(F.col, "xyz")), *apart, *[F.col(c).cast("int").alias(c) for c in "xyz"], F.lit(solid is None).alias("fills"), whole.alias("row"))
    beside = [F.when(F.pmod(F.col(c), F.lit(SIDE)) == at, F.struct(*[F.lit(d if c == k else 0).alias(f"d{k}") for k in "xyz"])) for c in "xyz" for at, d in ((0, -1), (SIDE - 1, 1))]
    here = [] if solid is None else [F.struct(*[F.lit(0).alias(f"d{k}") for k in "xyz"])]
    ways = F.explode(F.filter(F.array(*here, *beside), lambda w: w.isNotNull())).alias("way")
    filling = (blocks if solid is None else solid).where(place).select(*apart, *[F.col(c).cast("int").alias(c) for c in "xyz"]).select("*", ways)
    filling = filling.select(*cube(*[F.col(c) + F.col(f"way.d{c}") for c in "xyz"]), *marks, *"xyz", F.lit(True).alias("fills"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))

    def look(part: pa.Table) -> pa.Table:
        at = [part.column(c).to_numpy() - SIDE * part.column(k)[0].as_py() + 1 for c, k in zip("xyz", keys, strict=True)]
        full = np.zeros((SIDE + 2,) * 3, bool)
        fills = part.column("fills").to_numpy(zero_copy_only=False).astype(bool)
        full[tuple(a[fills] for a in at)] = True
        rows = part.column("row").combine_chunks()
        own = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
        free = [own[~full[tuple(a[own] + d for a, d in zip(at, side, strict=True))]] for side in SIDES6]
        taken = rows.take(pa.array(np.concatenate(free)))
        steps = np.repeat(np.array(SIDES6, np.int32), list(map(len, free)), axis=0)
        return pa.Table.from_arrays([*taken.flatten(), *[pa.array(steps[:, k]) for k in range(3)]], [*[f"k{k}" for k in range(len(taken.type))], "dx", "dy", "dz"])

    schema = T.StructType([T.StructField(f"k{k}", f.dataType) for k, f in enumerate(blocks.schema.fields)] + [T.StructField(c, T.IntegerType()) for c in ("dx", "dy", "dz")])
    found = own.unionByName(filling).repartition(n, *keys, *marks).groupBy(*keys, *marks).applyInArrow(look, schema)
    return found.toDF(*blocks.columns, "dx", "dy", "dz")
