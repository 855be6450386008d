"""Structure reports: what stands where a building is marked, with meshes, as rows, JSON and one HTML page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import classified
from ..functions.props import as_map, relevant
from ..functions.storage import apart
from .encode import code_of, decoded
from .mesh import face_color, faces, triangles

PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>__WORLD_NAME__</title></head>
<body><h1>__WORLD_NAME__</h1><pre id="list"></pre><script>
const structures = __STRUCTURES_JSON__;
document.getElementById("list").textContent = structures.map(s => `${s.id}: ${s.count} blocks, ${s.bbox.join(" ")}`).join("\\n");
</script></body></html>
"""


def structure_blocks(buildings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(building_id, x, y, z, name, prop, shape, color, top_color): buildings' blocks as they were. Places that blocks lack drop out."""
    met = buildings.select("building_id", "x", "y", "z").join(apart(blocks.select("x", "y", "z", "name", "prop")), ["x", "y", "z"])
    return classified(met, "shape", "color", "top_color")


def boxes(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(building_id, keys, min_x .. max_z, n): extents and number of blocks."""
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return rows.groupBy("building_id", *keys).agg(*ends, F.count("*").alias("n"))


def structure_faces(rows: DataFrame) -> DataFrame:
    """Exposed faces of cubes, where only cubes of the same building hide one, with face_color."""
    cubes = rows.where("shape = 'cube'")
    return faces(cubes, cubes, ("building_id",)).withColumn("face_color", face_color())


def structures(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, blocks, cubeMeshes, bbox, count): a row per building, in the form that the page reads; blocks by place.

    One building is one row, of any size: tiles() gives it in pieces. keys: further columns that rows are kept apart by.
    """
    by = ("building_id", *keys)
    other = rows.where("shape <> 'cube'")
    props = F.map_filter(relevant(as_map(F.col("prop"))), lambda k, v: v.isNotNull())
    block = F.struct("x", "y", "z", F.col("name").alias("n"), F.col("shape").alias("s"), F.col("color").alias("c"), F.col("top_color").alias("t"), F.array_sort(F.map_entries(props)).alias("p"))
    with_map = lambda b: b.withField("p", F.when(F.size(b["p"]) > 0, F.map_from_entries(b["p"])))
    blocks = other.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(block)), with_map).alias("blocks"))
    tri = triangles(structure_faces(rows))
    piece = F.struct("x", "y", "z", "dx", "dy", "dz", "triangle", "pos", F.flatten(F.array_repeat("normal", 3)).alias("nrm"))
    mesh = tri.groupBy(*by, "face_color").agg(F.array_sort(F.collect_list(piece)).alias("t"))
    mesh = mesh.select(*by, F.struct(F.col("face_color").alias("color"), F.flatten(F.transform("t", lambda p: p["pos"])).alias("pos"), F.flatten(F.transform("t", lambda p: p["nrm"])).alias("nrm")).alias("m"))
    meshes = mesh.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("cubeMeshes"))
    box = F.array("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
    out = boxes(rows, keys).join(blocks, list(by), "left").join(meshes, list(by), "left")
    return out.select(F.col("building_id").alias("id"), *keys, F.coalesce("blocks", F.array()).alias("blocks"), F.coalesce("cubeMeshes", F.array()).alias("cubeMeshes"), box.alias("bbox"), F.col("n").alias("count"))


#: Places along each side of a tile.
TILE = 16


def tiles(rows: DataFrame) -> DataFrame:
    """(id, tile_x, tile_y, tile_z, blocks, cubeMeshes, bbox, count): structures cut into tiles of 16 places a side.

    A tile holds at most 4096 places, so no row grows with a building. Faces are those of the whole building.
    """
    own = rows.select("*", *[F.floor(F.col(c) / TILE).cast("int").alias(f"tile_{c}") for c in "xyz"])
    return structures(own, ("tile_x", "tile_y", "tile_z"))


def marked_structures(marked: DataFrame, marked_names: DataFrame, codes: DataFrame, names: DataFrame, props: DataFrame, marker: str = "building_marker") -> DataFrame:
    """Structure blocks from two worlds of codes: marked says where buildings stand, codes what stands there.

    marked, codes: id, prop, x, y, z; dictionaries (id, name) and (prop, raw). A building's number is the prop of its markers.
    LookupError if marked_names has no marker. Codes that names lack become unknown_<code>; places that codes lack drop out.
    """
    code = code_of(marked_names, marker)
    places = marked.where(F.col("id") == code).select(F.col("prop").alias("building_id"), "x", "y", "z")
    blocks = decoded(codes, names, props, missing="id").select("x", "y", "z", "name", F.col("prop_raw").alias("prop"))
    return structure_blocks(places, blocks)


def as_json(rows: DataFrame) -> DataFrame:
    """(id, json): a structure per row; written as text, this is the report at any size."""
    return structures(rows).select("id", F.to_json(F.struct("id", "blocks", "cubeMeshes", "bbox", "count")).alias("json"))


def write_page(rows: DataFrame, name: str, path: str, most_bytes: int = 256 << 20) -> None:
    """One self-contained page. A page is for one reader, so its size is checked before anything is brought to the driver."""
    found = as_json(rows)
    size = found.agg(F.sum(F.octet_length("json"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of structures are too many for a page; write as_json() instead")
    text = ",".join(r.json for r in found.orderBy("id").toLocalIterator())
    with open(path, "w", encoding="utf-8") as out:
        out.write(PAGE.replace("__STRUCTURES_JSON__", "[" + text.replace("</", "<\\/") + "]").replace("__WORLD_NAME__", json.dumps(name)[1:-1]))
