"""Trees: found, checked, cleaned and taken out of a block table.

Layers are linked from above by a first-claim rule in scan order. What a layer adopts depends on two adjacent layers
alone, so all pairs of layers are worked on at once, in tiles that settle what crosses their edges; one run of connected
components then joins what is linked. All checks after that are grouped by tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import packed
from ..functions.names import classified
from ..functions.props import axis
from ..functions.storage import apart, stored
from . import adoption
from .graph import connected_components, reachable
from .neighbors import ALL26, CROSS5_BELOW, HALF_PLANE4, PLANE4, PLANE8, SIDES6, neighbors
from .shapes import Plane, l_cells
from .tiles import SIDE, settled, with_edges

PLACE = ["x", "y", "z"]
#: Cells along the side of a tile in which a layer's adoptions are worked out.
TILE_SIDE = SIDE
#: Lots of layers, for each shuffle partition, in which shapes are looked for.
LOTS = 64
#: Cells up to which a layer is a set; arrays take longer to set up.
FEW = 64


def _node(prefix: str = "") -> Column:
    return packed(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z"))


def relevant(blocks: DataFrame) -> DataFrame:
    """Tree blocks and ground that trees stand on: x, y, z, name, material (log, wood, leaf or null), variety, axis, is_stumpable, node."""
    known = classified(blocks.select(*PLACE, "name", "prop"), "material", "variety", "is_stumpable")
    rows = known.where("material is not null or is_stumpable")
    return rows.select(*PLACE, "name", "material", "variety", axis(F.col("prop")).alias("axis"), "is_stumpable", _node().alias("node"))


def is_wood() -> Column:
    return F.col("material").isin("log", "wood")


def in_plane_edges(cells: DataFrame, same_variety: bool = True) -> DataFrame:
    """(src, dst): 4-adjacent tree blocks of a layer, of one variety unless any will do."""
    tree = cells.where("material is not null")
    met = neighbors(tree, tree, HALF_PLANE4, keep=("variety", "node"))
    return (met.where("variety = n_variety") if same_variety else met).select(F.col("node").alias("src"), F.col("n_node").alias("dst"))


def below_edges(cells: DataFrame, same_variety: bool = True) -> DataFrame:
    """(src, dst): tree blocks and those in the cross below that they could adopt. Logs that lie flat adopt nothing."""
    tree = cells.where("material is not null")
    upper = tree.where(~is_wood() | (F.coalesce("axis", F.lit("")) == "y")) if same_variety else tree
    met = neighbors(upper, tree, CROSS5_BELOW, keep=("variety", "node"))
    return (met.where("variety = n_variety") if same_variety else met).select(F.col("node").alias("src"), F.col("n_node").alias("dst"))


def adoption_edges_approx(cells: DataFrame) -> DataFrame:
    """(src, dst): each tree block and the first, by x and z, of the blocks above that could adopt it. Approximate: floods are left out."""
    return below_edges(cells).groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")  # of one layer, so nodes go by x and z


def adopt(upper: dict, lower: dict, guarded: bool) -> list[tuple[tuple, tuple]]:
    """(upper place, lower place) of all adoptions between two whole layers. upper: place -> (variety, adopts), lower: place -> (variety, is_flat, is_wood)."""
    whole = adoption.Tile(upper, lower, lambda place: True, guarded)
    whole.run([])
    return [(time[:2], place) for place, time in whole.claimed.items()]


def adoption_edges(cells: DataFrame, same_variety: bool = True, within: str | None = None) -> DataFrame:
    """(src, dst): exact adoptions between layers, tile by tile, whatever a canopy's size.

    same_variety: the rule for trees; otherwise any blocks join (within: a column that must be equal for that).
    """
    kind = F.coalesce("variety", F.lit(-1)) if same_variety else F.col(within) if within else F.lit(0)
    flat = F.coalesce(is_wood() & (F.coalesce("axis", F.lit("")) != "y"), F.lit(False)) if same_variety else F.lit(False)
    rows = cells.where("material is not null").select("x", "z", "y", kind.cast("long").alias("kind"), flat.alias("flat"), is_wood().alias("wood"))
    both = F.explode(F.array(F.struct(F.col("y").alias("level"), F.lit(True).alias("is_upper")), F.struct((F.col("y") + 1).alias("level"), F.lit(False).alias("is_upper"))))
    rows = rows.select("*", both.alias("in")).select("x", "z", "in.level", "in.is_upper", "kind", "flat", "wood").where("not (is_upper and flat)")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = with_edges(rows, TILE_SIDE).repartition(n, "tile").groupBy("tile")
    parted = stored(tiles.applyInArrow(adoption.parted(same_variety, TILE_SIDE), "src long, dst long, x int, z int, level int, is_upper boolean, kind long, flat boolean, wood boolean, tile long, inside boolean"), "adoption-parted")
    crossing = settled(parted.where("src is null").drop("src", "dst"), adoption.look(same_variety, TILE_SIDE), "src long, dst long", "adoption")
    return parted.where("src is not null").select("src", "dst").unionByName(crossing)


def components(cells: DataFrame, exact: bool = True) -> DataFrame:
    """(tree_id, ...cells): every tree block with its tree, and the ground that trees stand on; a tree is named by its least node."""
    edges = in_plane_edges(cells).unionByName(adoption_edges(cells) if exact else adoption_edges_approx(cells))
    found = connected_components(edges).select("node", F.col("component").alias("tree_id"))
    tree = cells.where("material is not null").join(apart(found), "node", "left").withColumn("tree_id", F.coalesce("tree_id", "node"))
    tree = stored(tree, "tree-cells")
    return tree.unionByName(ground(cells, tree))


def ground(cells: DataFrame, trees: DataFrame) -> DataFrame:
    """Ground right below an upright log or wood block of a tree, as part of it."""
    stems = trees.where(is_wood() & (F.col("axis") == "y")).select("x", (F.col("y") - 1).alias("y"), "z", "tree_id")
    return cells.where("material is null").join(apart(stems), PLACE).select(*trees.columns)


def statuses(trees: DataFrame) -> DataFrame:
    """(tree_id, status): keep, foliage or discard.

    A stump is valid if there is ground and the layer of the lowest log has wood or an upright log. Without a valid
    stump: foliage if there is a leaf, else discard. With one: discard if there is no leaf.
    """
    wood_y = F.when(is_wood(), F.col("y"))
    firm = F.when(is_wood() & ((F.col("material") == "wood") | (F.col("axis") == "y")), F.col("y"))
    facts = trees.groupBy("tree_id").agg(F.bool_or("is_stumpable").alias("ground"), F.bool_or(F.coalesce(F.col("material") == "leaf", F.lit(False))).alias("leaf"), F.min(wood_y).alias("low"), F.min(firm).alias("firm"))
    valid = F.col("ground") & F.coalesce(F.col("low") == F.col("firm"), F.lit(False))
    return facts.select("tree_id", F.when(valid & F.col("leaf"), "keep").when(~valid & F.col("leaf"), "foliage").otherwise("discard").alias("status"))


def reached_logs(trees: DataFrame) -> DataFrame:
    """(tree_id, node): logs of a tree reached from its upright logs and wood blocks; a flat log leads sideways only."""
    logs = trees.where(is_wood()).withColumn("lies", (F.col("material") == "log") & F.col("axis").isin("x", "z"))
    logs = logs.withColumn("lies", F.coalesce("lies", F.lit(False)))
    seeds = logs.where((F.col("material") == "wood") | (F.col("axis") == "y"))
    met = neighbors(logs, logs, SIDES6, keep=("tree_id", "node")).where("tree_id = n_tree_id and (not lies or dy = 0)")
    found = reachable(seeds.select("node"), met.select(F.col("node").alias("src"), F.col("n_node").alias("dst")))
    return logs.join(apart(found), "node").select("tree_id", "node")


def axis_misfits(trees: DataFrame) -> DataFrame:
    """(tree_id, node): flat logs to drop. One stays if a block next to it along its axis has another axis, or any of the eight around it in its layer has none."""
    flat = trees.where((F.col("material") == "log") & F.col("axis").isin("x", "z"))
    around = neighbors(flat, trees, PLANE8, keep=("tree_id", "axis")).where("tree_id = n_tree_id")
    along = ((F.col("axis") == "x") & (F.col("dz") == 0)) | ((F.col("axis") == "z") & (F.col("dx") == 0))
    fits = around.where((along & (F.col("n_axis") != F.col("axis"))) | F.col("n_axis").isNull()).select("tree_id", "node").distinct()
    return flat.select("tree_id", "node").join(apart(fits), ["tree_id", "node"], "left_anti")


def _by_layer(trees: DataFrame, find: Callable[[Plane, list], set], of_lone: Callable[[Column, Column], Column]) -> DataFrame:
    """(tree_id, x, z): places that find gives for a tree's layers, each with the layer below it.

    Most layers are one block, and these need no task in Python: of_lone says what find gives for one, by whether a square that
    begins there has room in the tree's box, and whether the tree has a block right below.
    """
    ends = [f(c).alias(f"{n}_{c}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))]
    boxes = trees.groupBy("tree_id").agg(*ends)
    rows = trees.join(apart(boxes), "tree_id").select("tree_id", *PLACE, F.coalesce(is_wood(), F.lit(False)).alias("wood"), "min_x", "max_x", "min_z", "max_z")
    both = rows.withColumn("level", F.col("y")).withColumn("under", F.lit(False)).unionByName(rows.withColumn("level", F.col("y") + 1).withColumn("under", F.lit(True)))

    at = F.struct("x", "z")
    layers = rows.groupBy("tree_id", F.col("y").alias("level")).agg(F.bool_or("wood").alias("logged"), F.min(at).alias("first"), F.max(at).alias("last"))
    layers = layers.where("logged").select("tree_id", "level", "first", (F.col("first") == F.col("last")).alias("lone"))  # a layer without logs has nothing to find
    both = both.join(apart(layers), ["tree_id", "level"])
    room = F.greatest(F.col("first.x") - F.col("min_x"), F.col("first.z") - F.col("min_z")) <= F.least(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"))
    lone = both.where("lone").groupBy("tree_id", "level").agg(F.first("first").alias("at"), F.first(room).alias("room"), F.bool_or(F.col("under") & (at == F.col("first"))).alias("stands"))
    lone = lone.where(of_lone(F.col("room"), F.col("stands"))).select("tree_id", "at.x", "at.z")
    both = both.where("not lone").drop("first", "lone")

    schema = pa.schema([("tree_id", pa.int64()), ("x", pa.int32()), ("z", pa.int32())])

    def of_layer(x0: int, z0: int, end_x: int, end_z: int, x: np.ndarray, z: np.ndarray, wood: np.ndarray, low: np.ndarray) -> list:
        place = np.stack((x - x0, z - z0), axis=1).astype(np.int64)
        filled = np.unique(place[~low], axis=0)
        key = lambda p: p[:, 0] * (end_z - z0 + 1) + p[:, 1]
        plane = Plane.of_cells(filled, filled[~np.isin(key(filled), key(place[low]))], (end_x - x0 + 1, end_z - z0 + 1))
        wood = wood & ~low
        return sorted(find(plane, sorted(map(tuple, place[wood].tolist())))) if wood.any() else []

    def look(part: pa.Table) -> pa.Table:
        tree, level, *box, x, z, wood, low = (part.column(c).to_numpy() for c in ("tree_id", "level", "min_x", "min_z", "max_x", "max_z", "x", "z", "wood", "under"))
        order = np.lexsort((level, tree))
        tree, level, *box, x, z, wood, low = (c[order] for c in (tree, level, *box, x, z, wood.astype(bool), low.astype(bool)))
        begins = np.flatnonzero(np.append(True, (np.diff(tree) != 0) | (np.diff(level) != 0)))
        found = []
        rows = list(zip(*((c - b).tolist() for c, b in ((x, box[0]), (z, box[1]))), wood.tolist(), low.tolist(), strict=True))
        for first, end in zip(begins.tolist(), [*begins[1:].tolist(), len(tree)], strict=True):
            x0, z0, end_x, end_z = (int(c[first]) for c in box)
            if end - first <= FEW:
                filled, under = ({(i, j) for i, j, _, lower in rows[first:end] if lower == which} for which in (False, True))
                plane = Plane.of_few(filled, filled - under, (end_x - x0 + 1, end_z - z0 + 1))
                own = sorted(find(plane, sorted((i, j) for i, j, is_log, lower in rows[first:end] if is_log and not lower)))
            else:
                own = of_layer(x0, z0, end_x, end_z, *(c[first:end] for c in (x, z, wood, low)))
            found += [(int(tree[first]), int(i) + x0, int(j) + z0) for i, j in own]
        return pa.Table.from_arrays([pa.array([row[k] for row in found], f.type) for k, f in enumerate(schema)], schema=schema)

    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be put together
    lot = F.pmod(F.xxhash64("tree_id", "level"), F.lit(LOTS * n)).alias("lot")  # several layers in a call, and not as the join has dealt them
    return both.select("*", lot).repartition(n, "lot").groupBy("lot").applyInArrow(look, "tree_id long, x int, z int").unionByName(lone).distinct()


def l_columns(trees: DataFrame) -> DataFrame:
    """(tree_id, x, z): columns of L shapes, which leave the tree on every layer."""
    return _by_layer(trees, l_cells, lambda room, stands: ~room & ~stands)


def square_columns(trees: DataFrame) -> DataFrame:
    """(tree_id, x, z): places where an isolated square of blocks begins."""
    from .shapes import is_square

    return _by_layer(trees, lambda plane, anchors: {a for a in anchors if is_square(plane, *a)}, lambda room, stands: room)


def cleaned(trees: DataFrame) -> DataFrame:
    """Kept trees without logs out of reach, L shapes, misfitting flat logs and ground."""
    reached = reached_logs(trees).select("node").distinct()
    logs = trees.where(is_wood()).join(apart(reached), "node", "left_semi")
    trees = stored(logs.unionByName(trees.where(F.coalesce(~is_wood(), F.lit(True)))), "tree-reached")
    columns = l_columns(trees)
    misfits = axis_misfits(trees)
    out = trees.join(apart(columns), ["tree_id", "x", "z"], "left_anti").join(apart(misfits), ["tree_id", "node"], "left_anti")
    return out.where("material is not null").select(*trees.columns)


def split_orphans(trees: DataFrame) -> DataFrame:
    """Trees cut into their connected parts, variety aside; of several parts, those without a leaf go. tree_id becomes the part's.

    A tree all of whose parts are without leaves goes as a whole.
    """
    trees = stored(trees, "tree-cleaned")
    owner = trees.select("node", "tree_id")
    planar = in_plane_edges(trees, same_variety=False)
    planar = planar.join(apart(owner.select(F.col("node").alias("src"), F.col("tree_id").alias("a"))), "src").join(apart(owner.select(F.col("node").alias("dst"), F.col("tree_id").alias("b"))), "dst").where("a = b").select("src", "dst")
    found = connected_components(planar.unionByName(adoption_edges(trees, same_variety=False, within="tree_id")))
    parts = trees.join(apart(found), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    facts = parts.groupBy("tree_id", "part").agg(F.bool_or(F.col("material") == "leaf").alias("leaf"))
    counts = facts.withColumn("n", F.count("*").over(Window.partitionBy("tree_id")))
    kept = counts.where("n = 1 or leaf").select("part")
    return parts.join(apart(kept), "part", "left_semi").withColumn("tree_id", F.col("part")).select(*trees.columns)


def attached_foliage(confirmed: DataFrame, foliage: DataFrame) -> DataFrame:
    """(tree_id): foliage that touches, corners included, a confirmed tree or foliage that does so."""
    met = neighbors(foliage, foliage, ALL26, keep=("tree_id",)).where("tree_id < n_tree_id")
    groups = stored(connected_components(met.select(F.col("tree_id").alias("src"), F.col("n_tree_id").alias("dst")).distinct()), "foliage-groups")
    first = stored(neighbors(foliage, confirmed, ALL26, "left_semi").select(F.col("tree_id").alias("node")).distinct(), "foliage-first")
    near = groups.join(apart(first), "node").select("component").distinct()
    return first.unionByName(groups.join(apart(near), "component", "left_semi").select("node")).distinct().select(F.col("node").alias("tree_id"))


def stumps(trees: DataFrame, cells: DataFrame) -> DataFrame:
    """(tree_id, x, y, z): each tree's stump: an upright log or wood block above ground, else above any tracked block, else the lowest log.

    Upright logs go before wood, ground before other blocks, then the lowest, then the least x and z.
    """
    under = cells.select("x", (F.col("y") + 1).alias("y"), "z", F.col("is_stumpable").alias("on_ground"))
    logs = trees.where(is_wood()).join(apart(under), PLACE, "left")
    upright = (F.col("material") == "log") & F.coalesce(F.col("axis") == "y", F.lit(False))
    wood = F.col("material") == "wood"
    tier = F.when(F.col("on_ground").isNull(), 5).when(upright & F.col("on_ground"), 1).when(wood & F.col("on_ground"), 2).when(upright, 3).when(wood, 4).otherwise(5)
    best = logs.groupBy("tree_id").agg(F.min(F.struct(tier.alias("tier"), "y", "x", "z")).alias("b"))
    return best.select("tree_id", "b.x", "b.y", "b.z")


def tree_lines(trees: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tree_id, y, x, z, line): each block of a tree as name:prop:x.y.z, for a text of all trees (mesh.write_file by tree, from the top down).

    blocks: x, y, z, name, prop. Without a name: other; without properties: None.
    """
    own = blocks.select(*PLACE, F.concat_ws(":", F.coalesce("name", F.lit("other")), F.coalesce("prop", F.lit("None")), F.format_string("%d.%d.%d", "x", "y", "z")).alias("line"))
    return trees.select("tree_id", *PLACE).join(apart(own), PLACE).select("tree_id", "y", "x", "z", "line")


def remove_trees(blocks: DataFrame, exact: bool = True) -> DataFrame:
    """(x, y, z, name, prop, role): the world without trees.

    Stumps become tree_marker and loose foliage foliage_marker, other blocks of trees go, the rest stays as it is. blocks:
    x, y, z, name, prop, one row per place.
    """
    roles = tree_roles(blocks, exact)
    out = blocks.join(apart(roles), PLACE, "left").where("role is null or role <> 'tree'")
    name = F.when(F.col("role") == "stump", "tree_marker").when(F.col("role") == "foliage", "foliage_marker").otherwise(F.col("name"))
    return out.select(*PLACE, name.alias("name"), "prop", F.coalesce("role", F.lit("other")).alias("role"))


def tree_roles(blocks: DataFrame, exact: bool = True) -> DataFrame:
    """(x, y, z, role): stump, foliage or tree, in this order of precedence, for blocks of trees and loose foliage."""
    cells = stored(relevant(blocks), "tree-relevant")
    trees = stored(components(cells, exact), "trees")
    status = stored(statuses(trees), "tree-status")
    of = lambda s: trees.join(apart(status.where(F.col("status") == s).select("tree_id")), "tree_id", "left_semi")
    kept = stored(split_orphans(cleaned(of("keep"))), "trees-kept")
    foliage = stored(of("foliage"), "tree-foliage")
    joined = stored(attached_foliage(kept, foliage), "tree-attached")
    confirmed = kept.unionByName(foliage.join(apart(joined), "tree_id", "left_semi").select(*kept.columns))
    loose = foliage.join(apart(joined), "tree_id", "left_anti")
    ranked = (
        stumps(confirmed, cells).select(*PLACE, F.lit(0).alias("rank"))
        .unionByName(loose.select(*PLACE, F.lit(1).alias("rank")))
        .unionByName(confirmed.select(*PLACE, F.lit(2).alias("rank")))
    )
    return ranked.groupBy(*PLACE).agg(F.min("rank").alias("rank")).select(*PLACE, F.element_at(F.array(F.lit("stump"), F.lit("foliage"), F.lit("tree")), F.col("rank") + 1).alias("role"))


__all__ = ["PLANE4", "adopt", "adoption_edges", "adoption_edges_approx", "attached_foliage", "axis_misfits", "below_edges", "cleaned", "components", "ground", "in_plane_edges", "l_columns", "reached_logs", "relevant", "remove_trees", "split_orphans", "square_columns", "statuses", "stumps", "tree_roles"]
