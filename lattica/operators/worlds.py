"""Worlds from files to files: read with their dictionaries, without their trees, with their buildings marked, and written again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import apart, discarded, published, stored
from ..sources.dicts import read_dictionary, write_dictionary
from ..sources.world import read_world, write_world
from . import buildings, encode, report, trees
from .blocks import last_wins

TREE_MARKERS, BUILDING_MARKER = ("tree_marker", "foliage_marker"), "building_marker"


@dataclass(frozen=True)
class World:
    """A world of codes, a row per place, with its dictionaries; spaces is None where it has no namespaces."""

    codes: DataFrame  # (ns,) id, prop, x, y, z
    names: DataFrame  # id, name
    props: DataFrame  # prop, raw
    spaces: DataFrame | None = None  # ns, space

    def blocks(self) -> DataFrame:
        """(x, y, z, name, prop) and, if the world has namespaces, ns, all as strings; unknown codes as unknown_<code>."""
        rows = encode.decoded(self.codes, self.names, self.props, missing="id")
        rest = []
        if self.spaces is not None:
            rows, rest = rows.join(self.spaces, "ns", "left"), [F.col("space").alias("ns")]
        return rows.select("x", "y", "z", "name", F.col("prop_raw").alias("prop"), *rest)


def encoded(blocks: DataFrame) -> World:
    """Blocks of strings (x, y, z, name, prop and, if there, ns) as a world with dictionaries of its own."""
    names, props, spaces = encode.dictionaries(blocks)
    return World(encode.encoded(blocks, names, props, spaces), names, props, spaces)


def load(spark: SparkSession, folder: str) -> World:
    """A world that save() wrote. Of records with one place the last of the last file counts."""
    rows = read_world(spark, f"{folder}/blocks")
    spaced = bool(rows.where("ns is not null").take(1))
    codes = last_wins(rows, "file", "pos").select(*["ns"] * spaced, "id", "prop", "x", "y", "z")
    spaces = read_dictionary(spark, f"{folder}/namespaces", "ns", "space") if spaced else None
    return World(codes, read_dictionary(spark, f"{folder}/ids"), read_dictionary(spark, f"{folder}/properties", "prop", "raw"), spaces)


def save(world: World, folder: str) -> DataFrame:
    """Writes blocks/ (compressed files), ids/, properties/ and, with namespaces, namespaces/; returns the files of blocks.

    All are written under another name beside the folder and get theirs in one step once they are whole: readers see a world with its
    dictionaries or none, and one that fails leaves nothing. A folder that holds something already is an error.
    """
    spark, folder = world.codes.sparkSession, folder.rstrip("/")
    draft = f"{folder}.{uuid.uuid4().hex}.draft"
    try:
        files = write_world(world.codes, f"{draft}/blocks")
        write_dictionary(world.names, f"{draft}/ids")
        write_dictionary(world.props, f"{draft}/properties", "prop", "raw")
        if world.spaces is not None:
            write_dictionary(world.spaces, f"{draft}/namespaces", "ns", "space")
        published(spark, draft, folder)
    except BaseException:
        discarded(spark, draft)
        raise
    return files.withColumn("path", F.replace("path", F.lit(draft), F.lit(folder)))


def without_trees(world: World, exact: bool = True) -> World:
    """The world without trees, stumps and loose foliage as markers; codes stay, and the dictionary gets the markers.

    Whatever stays keeps its properties and namespace.
    """
    names = stored(encode.with_markers(world.names, *TREE_MARKERS), "tree-names")
    roles = trees.tree_roles(world.blocks().select("x", "y", "z", "name", "prop"), exact)
    stump, foliage = (encode.code_of(names, m) for m in TREE_MARKERS)
    rows = world.codes.join(apart(roles), ["x", "y", "z"], "left").where("role is null or role <> 'tree'")
    code = F.when(F.col("role") == "stump", stump).when(F.col("role") == "foliage", foliage).otherwise(F.col("id"))
    return World(rows.withColumn("id", code).select(*world.codes.columns), names, world.props, world.spaces)


def with_buildings(world: World) -> World:
    """The world with every block of a building as a marker, whose prop is the building's number."""
    names = stored(encode.with_markers(world.names, BUILDING_MARKER), "building-names")
    marker = encode.code_of(names, BUILDING_MARKER)
    found = buildings.find_buildings(world.blocks()).select("x", "y", "z", "building_id")
    rows = world.codes.join(apart(found), ["x", "y", "z"], "left")
    own = F.col("building_id").isNotNull()
    rows = rows.withColumn("id", F.when(own, marker).otherwise(F.col("id"))).withColumn("prop", F.when(own, F.col("building_id")).otherwise(F.col("prop")))
    return World(rows.select(*world.codes.columns), names, world.props, world.spaces)


def structures(marked: World, world: World) -> DataFrame:
    """Structure blocks of the buildings that one world marks, as they stand in the other."""
    return report.marked_structures(marked.codes, marked.names, world.codes, world.names, world.props)
