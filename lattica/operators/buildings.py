"""Buildings: unnatural blocks searched from the top down, discards, merges and the marked world.

An in-plane component of unnatural blocks goes whole to the earliest component that reaches it, so those are worked out
once, for all planes; the search then goes down in tiles of columns, all at once. Components are ordered by their first
block: highest first, then by x and z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import packed
from ..functions.names import classified
from ..functions.naming import fresh
from ..functions.storage import apart, stored
from . import search
from .graph import connected_components
from .neighbors import HALF_PLANE8, SIDES6, SQUARE9_BELOW, neighbors, stepped
from .order import numbered
from .tiles import settled, tile_of

TINY = 5
#: Blocks along the side of a tile of columns.
TILE_SIDE = 64


def plane_components(blocks: DataFrame) -> DataFrame:
    """(x, y, z, plane): unnatural blocks with their 8-connected component in the plane, named by its least node."""
    cells = blocks.where("not is_natural").select("x", "y", "z", packed(F.col("x"), F.col("y"), F.col("z")).alias("node"))
    pairs = neighbors(cells, cells, HALF_PLANE8, keep=("node",)).select(F.col("node").alias("src"), F.col("n_node").alias("dst"))
    found = connected_components(pairs)
    return cells.join(apart(found), "node", "left").select("x", "y", "z", F.coalesce("component", "node").alias("plane"))


def below(layer: DataFrame) -> DataFrame:
    """Distinct (comp, x, y, z) in the 3x3 places below a layer's blocks.

    Blocks are dealt by tile first: those around a place then meet in one task, nearly all, and few rows are left to be held and shuffled.
    """
    n = int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = layer.select("comp", "x", "y", "z").repartition(n, tile_of(F.col("x"), F.col("z"), F.col("y"), TILE_SIDE))
    return stepped(dealt, SQUARE9_BELOW).select("comp", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")).distinct()


def of_components(claims: DataFrame, facts: DataFrame, how: str = "inner", key: str = "comp") -> DataFrame:
    """claims (with x and z) joined to facts on key, a component, of which facts have one row at most.

    A component may be most of the world, so blocks are dealt by component and tile; facts go to the tiles of their components first.
    """
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (tile,) = fresh(claims, "_tile")
    claims = claims.withColumn(tile, tile_of(F.col("x"), F.col("z"), F.lit(0), TILE_SIDE))
    parts = claims.select(key, tile).distinct().join(apart(facts), key)
    return claims.repartition(n, key, tile).join(apart(parts), [key, tile], how).drop(tile)


def raw_components(blocks: DataFrame) -> DataFrame:
    """(x, y, z, comp) for every block that a component claims; comp orders components by first block.

    blocks: x, y, z, is_natural, one row per place. The world is cut into columns of tiles; each is searched from the top down by
    itself (search.py), and the few facts that cross their sides go back and forth until they stand still, so jobs do not grow with
    the height. Components that claim nothing on a level end there. No unnatural block: no rows.
    """
    planes = plane_components(blocks)
    tile = tile_of(F.col("x"), F.col("z"), F.lit(0), TILE_SIDE)
    cells = blocks.select("x", "y", "z").join(apart(planes), ["x", "y", "z"], "left").withColumn("tile", tile)
    # A plane component's rank as a seed: higher planes first, then the least x and z among its blocks.
    rank = F.shiftleft((F.lit(1 << 14) - F.col("y")).cast("long"), 48).bitwiseOR(F.shiftleft((F.col("x") + (1 << 23)).cast("long"), 24)).bitwiseOR((F.col("z") + (1 << 23)).cast("long"))
    parts = stored(cells.where("plane is not null").groupBy("plane", "tile").agg(F.min(rank).alias("rank")), "building-planes")
    about = stored(parts.groupBy("plane").agg(F.min("rank").alias("seed"), (F.count("*") > 1).alias("shared")), "building-seeds")
    members = stored(parts.join(apart(about.where("shared")), "plane").select("plane", "tile"), "building-shared")
    seeds = parts.select("plane", "tile").join(apart(about), "plane")  # by tile too: natural blocks have no plane, and one may be a whole level
    found = settled(cells.join(apart(seeds), ["plane", "tile"], "left"), search.look(TILE_SIDE), "x long, y long, z long, comp long", "building", lambda facts: search.routed(facts, members))
    return found.select(*[F.col(c).cast(blocks.schema[c].dataType) for c in "xyz"], "comp")


def uniform_discards(claims: DataFrame) -> DataFrame:
    """(comp): components whose unnatural blocks all have one discardable name. claims: comp, name, is_natural, is_discardable."""
    kinds = claims.where("not is_natural").groupBy("comp").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.bool_and("is_discardable").alias("all"))
    return kinds.where("low = high and all").select("comp")


def tiny_discards(claims: DataFrame, most: int = TINY) -> DataFrame:
    """(comp): components of at most so many blocks, all of one name."""
    kinds = claims.groupBy("comp").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("*").alias("n"))
    return kinds.where((F.col("low") == F.col("high")) & (F.col("n") <= most)).select("comp")


def touching(claims: DataFrame) -> DataFrame:
    """(a, b), a < b: components with a face in common."""
    met = neighbors(claims, claims, SIDES6[::2], keep=("comp",)).where("comp <> n_comp")
    return met.select(F.least("comp", "n_comp").alias("a"), F.greatest("comp", "n_comp").alias("b")).distinct()


def sandwiched(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(x, y, z, a, b), a < b: unclaimed blocks in a straight line between blocks of two components."""
    free = blocks.select("x", "y", "z").join(apart(claims.select("x", "y", "z")), ["x", "y", "z"], "left_anti")
    one = neighbors(free, claims, SIDES6[::2], keep=("comp",)).select("x", "y", "z", "dx", "dy", "dz", F.col("n_comp").alias("one"))
    other = neighbors(free, claims, SIDES6[1::2], keep=("comp",)).select("x", "y", "z", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("dz")).alias("dz"), F.col("n_comp").alias("other"))
    met = one.join(apart(other), ["x", "y", "z", "dx", "dy", "dz"]).where("one <> other")
    return met.select("x", "y", "z", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()


def merged(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(building_id, x, y, z, absorbed): touching and sandwiched components joined, numbered from 0 by first component.

    Every unclaimed block between two components joins their building; one between several joins the lowest number.
    """
    between = stored(sandwiched(claims, blocks), "building-between")
    roots = connected_components(touching(claims).unionByName(between.select("a", "b").distinct()), "a", "b")
    owners = claims.select("comp").distinct().join(apart(roots.select(F.col("node").alias("comp"), F.col("component").alias("root"))), "comp", "left").select("comp", F.coalesce("root", "comp").alias("root"))
    roots = numbered(owners.select("root").distinct(), ["root"], "building_id").withColumn("building_id", F.col("building_id").cast("int"))
    labels = stored(owners.join(apart(roots), "root").select("comp", "building_id"), "building-labels")
    own = of_components(claims, labels).select("building_id", "x", "y", "z", F.lit(False).alias("absorbed"))
    joined = of_components(between, labels.withColumnRenamed("comp", "a"), key="a").groupBy("x", "y", "z").agg(F.min("building_id").alias("building_id"))
    return own.unionByName(joined.select("building_id", "x", "y", "z", F.lit(True).alias("absorbed")))


#: What a search counts, in this order.
COUNTERS = ("blocks", "components", "uniform", "tiny", "buildings", "marked")


class Counters:
    """Numbers of a search, taken from the writes that it makes anyway."""

    def __init__(self):
        self.seen: list[Observation] = []

    def on(self, df: DataFrame, **sums: Column) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in sums.items()])

    def row(self) -> DataFrame:
        """(blocks, components, uniform, tiny, buildings, marked): blocks read, components found, those discarded as all of one discardable
        name and as tiny, buildings after merging, blocks that belong to one. For after the search."""
        found = {k: v for s in self.seen for k, v in s.get.items()}
        spark = SparkSession.getActiveSession()
        return spark.range(1).select(*[F.lit(found.get(k, 0)).cast("long").alias(k) for k in COUNTERS])


def kept(claims: DataFrame, counters: Counters | None = None, most: int = TINY) -> DataFrame:
    """claims without the components that are discarded: as uniform, and of the others as tiny, by one grouped pass."""
    kinds = claims.groupBy("comp").agg(
        *[f(F.when(~F.col("is_natural"), F.col("name"))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))],
        F.bool_and(F.when(~F.col("is_natural"), F.col("is_discardable"))).alias("all"),
        F.min("name").alias("least"), F.max("name").alias("greatest"), F.count("*").alias("n"),
    )
    uniform = F.coalesce((F.col("low") == F.col("high")) & F.col("all"), F.lit(False))
    tiny = ~uniform & F.coalesce(F.col("least") == F.col("greatest"), F.lit(False)) & (F.col("n") <= most)
    kinds = kinds.select("comp", uniform.alias("uniform"), tiny.alias("tiny"))
    if counters:
        kinds = counters.on(kinds, components=F.count("*"), uniform=F.count_if("uniform"), tiny=F.count_if("tiny"))
    bad = stored(kinds, "building-kinds").where("uniform or tiny").select("comp")
    return stored(of_components(claims, bad, "left_anti"), "building-kept")


def from_claims(named: DataFrame, claims: DataFrame, counters: Counters | None = None) -> DataFrame:
    """(building_id, x, y, z, absorbed): what discards and merges make of claims."""
    found = merged(kept(claims, counters), named)
    if counters:
        found = stored(counters.on(found, marked=F.count("*"), buildings=F.max("building_id") + 1), "building-found")
    return found


def find_buildings(blocks: DataFrame, counters: Counters | None = None) -> DataFrame:
    """(building_id, x, y, z, absorbed) from blocks x, y, z, name. Without a name: as `other`; of a place that repeats, the greatest name counts.

    counters: gets the numbers of the search.
    """
    once = blocks.groupBy("x", "y", "z").agg(F.max(F.coalesce("name", F.lit("other"))).alias("name"))
    named = classified(once, "is_natural", "is_discardable")
    named = stored(counters.on(named, blocks=F.count("*")) if counters else named, "building-blocks")
    claims = stored(raw_components(named).join(apart(named), ["x", "y", "z"]), "building-claims")
    return from_claims(named, claims, counters)


def marked(blocks: DataFrame, buildings: DataFrame, marker: str = "building_marker") -> DataFrame:
    """blocks with building_id, and the marker as name, where a building stands."""
    own = buildings.select("x", "y", "z", "building_id")
    return blocks.join(apart(own), ["x", "y", "z"], "left").withColumn("name", F.when(F.col("building_id").isNotNull(), marker).otherwise(F.col("name")))
