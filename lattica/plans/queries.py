"""Queries over the derived block table, one or more for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, props
from ..functions.names import CLASSES, block_classes, classified
from ..functions.storage import apart, stored
from ..operators import blocks as B
from ..operators import buildings, encode, mesh, neighbors, report, trees
from ..operators.graph import connected_components
from ..sources import legacy
from . import synth
from .synth import VOX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query on the block table, with its SQL over vox if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{VOX}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return add


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.blocks(spark, sf_dir)


def _place(*rest: str) -> list[str]:
    return ["x", "y", "z", *rest]


# --- scans, filters, clipping --------------------------------------------------------------------


@query("SELECT x, y, z, name, prop FROM vox WHERE name = 'oak_log'")
def block_search(spark, d):
    return B.search(vox(spark, d), '"Oak_Log"')


@query("SELECT name || ':' || prop || ':' || x || '.' || y || '.' || z AS line FROM vox")
def block_dump(spark, d):
    return B.dump_lines(vox(spark, d))


@query("SELECT x, y, z, name FROM vox WHERE right(name, 3) <> 'air' AND y >= -4 AND y < 10")
def air_and_y_clip(spark, d):
    return B.clip_height(B.without_air(vox(spark, d)), -4, 10).select(*_place("name"))


@query("SELECT x, y, z, name FROM vox WHERE x >= -20 AND x < 15 + 1 AND z >= -10 AND z < 20")
def xz_clip_reference(spark, d):
    return B.clip_sides(vox(spark, d), (-20, 15), (-10, 20)).select(*_place("name"))


@query("SELECT x, y, z, name FROM vox WHERE x BETWEEN -20 AND 14 AND z BETWEEN -10 AND 20")
def xz_clip_inclusive(spark, d):
    return B.clip_sides(vox(spark, d), (-20, 14), (-10, 20), "inclusive").select(*_place("name"))


@query("SELECT CAST(floor(x / 16.0) AS INT) AS cx, CAST(floor(z / 16.0) AS INT) AS cz, count(*) AS n FROM vox WHERE floor(x / 16.0) BETWEEN -2 AND 0 AND floor(z / 16.0) BETWEEN -1 AND 1 GROUP BY ALL")
def chunk_prune(spark, d):
    return B.chunk_counts(B.chunks_within(vox(spark, d), (-20, 14), (-10, 20)))


@query("SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM vox")
def extents(spark, d):
    return B.extents(vox(spark, d))


@query("SELECT y, count(*) AS n FROM vox GROUP BY y")
def layer_histogram(spark, d):
    return vox(spark, d).groupBy("y").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT name FROM vox")
def distinct_names(spark, d):
    return vox(spark, d).select("name").distinct()


@query(f"SELECT {CLASSES['category']} AS category, count(*) AS n FROM vox GROUP BY 1")
def category_counts(spark, d):
    return classified(vox(spark, d), "category").groupBy("category").agg(F.count("*").alias("n"))


# --- codecs and properties -----------------------------------------------------------------------


@query("SELECT x, z, CASE WHEN x < 0 THEN (-x) | 32768 ELSE x END::BIGINT AS ex, CASE WHEN z < 0 THEN (-z) | 8388608 ELSE z END::BIGINT AS ez, count(*) AS n FROM vox GROUP BY ALL")
def signmag_encode(spark, d):
    return vox(spark, d).groupBy("x", "z").agg(F.count("*").alias("n")).select("x", "z", codec.sign_encoded(F.col("x"), 2).alias("ex"), codec.sign_encoded(F.col("z"), 3).alias("ez"), "n")


@query("SELECT CAST(x + 48 AS BIGINT) AS raw, CASE WHEN ((x + 48) & 128) <> 0 THEN -((x + 48) & 127) ELSE x + 48 END::BIGINT AS value, count(*) AS n FROM vox GROUP BY ALL")
def signmag_decode(spark, d):
    raw = (F.col("x") + 48).cast("long")
    return vox(spark, d).groupBy(raw.alias("raw")).agg(F.count("*").alias("n")).select("raw", codec.sign_decoded(F.col("raw"), 1).alias("value"), "n")


@query("SELECT x, y, z, x::BIGINT * 274877906944 + (z + 33554432)::BIGINT * 4096 + (y + 2048)::BIGINT AS node FROM vox")
def pack_coord(spark, d):
    return vox(spark, d).select(*_place(), codec.packed(F.col("x"), F.col("y"), F.col("z")).alias("node"))


@query("SELECT count(*) AS n, 1 AS code, 1 AS wx, 1 AS wy, 1 AS wz FROM vox")
def byte_widths(spark, d):
    rows = vox(spark, d)
    w = codec.inferred_widths(rows.select(F.lit(19).alias("id"), F.lit(3).alias("prop"), *_place()))
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(w["code"]).alias("code"), *[F.lit(w[c]).alias(f"w{c}") for c in "xyz"])


@query("SELECT k, v, count(*) AS n FROM (SELECT split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v FROM (SELECT unnest(string_split(prop, ',')) AS kv FROM vox)) GROUP BY ALL")
def prop_map(spark, d):
    return vox(spark, d).select(F.explode(props.as_map(F.col("prop"))).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


@query("SELECT array_to_string(list_sort(string_split(prop, ',')), ',') AS canonical, count(*) AS n FROM vox GROUP BY ALL")
def prop_canonical(spark, d):
    return vox(spark, d).groupBy(props.canonical(props.as_map(F.col("prop"))).alias("canonical")).agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(prop, 'axis=([xyz])', 1) AS axis, count(*) AS n FROM vox GROUP BY ALL")
def axis_counts(spark, d):
    return vox(spark, d).groupBy(props.axis(F.col("prop")).alias("axis")).agg(F.count("*").alias("n"))


@query("SELECT k, count(*) AS n FROM (SELECT split_part(unnest(string_split(prop, ',')), '=', 1) AS k FROM vox) WHERE k IN ('axis', 'half', 'powered') GROUP BY ALL")
def prop_filter(spark, d):
    return vox(spark, d).select(F.explode(F.map_keys(props.relevant(props.as_map(F.col("prop"))))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- dictionaries --------------------------------------------------------------------------------

_DICTS = "+ids AS (SELECT dense_rank() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT name FROM vox)), prs AS (SELECT dense_rank() OVER (ORDER BY prop) - 1 AS prop_id, prop FROM (SELECT DISTINCT prop FROM vox)) "


def _encoded(spark, d):
    rows = vox(spark, d)
    return rows, encode.dictionary(rows, "name"), encode.dictionary(rows.select(F.col("prop").alias("raw")), "raw", "prop")


@query(_DICTS + "SELECT id, prop_id AS prop, x, y, z FROM vox JOIN ids USING (name) JOIN prs USING (prop)")
def dict_encode(spark, d):
    return encode.encoded(*_encoded(spark, d))


@query("SELECT x, y, z, name, prop AS prop_raw FROM vox")
def dict_decode(spark, d):
    rows, names, raws = _encoded(spark, d)
    return encode.decoded(encode.encoded(rows, names, raws), names, raws).select(*_place("name", "prop_raw"))


@query(_DICTS + "SELECT 19 - id AS id, x, y, z FROM vox JOIN ids USING (name)")
def dict_remap(spark, d):
    rows, names, raws = _encoded(spark, d)
    new = names.select((F.lit(19) - F.col("id")).alias("id"), "name")
    return encode.remapped(encode.encoded(rows, names, raws), names, new).select("id", *_place())


@query(_DICTS + "SELECT CAST(id AS INT) AS id, name FROM ids UNION ALL SELECT CAST((SELECT max(id) FROM ids) + k AS INT), m FROM (VALUES (1, 'tree_marker'), (2, 'foliage_marker')) AS t(k, m)")
def dict_with_markers(spark, d):
    return encode.with_markers(encode.dictionary(vox(spark, d), "name"), "tree_marker", "foliage_marker")


# --- classes of names ----------------------------------------------------------------------------


def _class_query(key: str, *columns: str):
    def f(spark, d):
        return block_classes(vox(spark, d), *columns)

    f.__name__ = key
    query("SELECT DISTINCT name, " + ", ".join(f"{CLASSES[c]} AS {c}" for c in columns) + " FROM vox")(f)


for _key, _columns in {"class_tree_material": ("material", "variety", "is_stumpable"), "class_natural": ("is_natural",), "class_discardable": ("is_discardable",), "class_render": ("category",), "class_shape": ("shape",), "class_color": ("color", "top_color")}.items():
    _class_query(_key, *_columns)


# --- orders and lines ----------------------------------------------------------------------------


@query("SELECT x, y, z, row_number() OVER (ORDER BY y DESC, x, z) AS place FROM vox WHERE name = 'stone'")
def sort_y_desc(spark, d):
    return legacy.ranked(vox(spark, d).where("name = 'stone'").select(*_place()), "y", True, ["x", "z"], "place")


@query("SELECT x, y, z, row_number() OVER (ORDER BY y DESC, x, z) AS place FROM vox")
def sort_y_desc_all(spark, d):
    return legacy.ranked(vox(spark, d).select(*_place()), "y", True, ["x", "z"], "place")


_LINES = "+lines AS (SELECT row_number() OVER (ORDER BY y, x, z) - 1 AS line_no, y, name || ':' || x || '.' || y || '.' || z AS value FROM vox WHERE name = 'sand') "


_ALL_LINES = _LINES.replace(" WHERE name = 'sand'", "")


def _lines(spark, d, kept="name = 'sand'"):
    rows = vox(spark, d).where(kept).select("x", "y", "z", F.concat_ws(":", "name", F.format_string("%d.%d.%d", "x", "y", "z")).alias("value"))
    rows = legacy.ranked(rows, "y", False, ["x", "z"], "line_no")
    return rows.select((F.col("line_no") - 1).alias("line_no"), "y", "value")


@query(_LINES + "SELECT value, row_number() OVER (ORDER BY y DESC, line_no) AS place FROM lines")
def line_sort_y_desc(spark, d):
    return legacy.sorted_by_height(_lines(spark, d).select("line_no", "value")).select("value", "place")


@query(_LINES + "SELECT value, row_number() OVER (ORDER BY line_no DESC) AS place FROM lines")
def line_reverse(spark, d):
    return legacy.reversed_lines(_lines(spark, d).select("line_no", "value")).select("value", "place")


@query(_ALL_LINES + "SELECT value, row_number() OVER (ORDER BY y DESC, line_no) AS place FROM lines")
def line_sort_y_desc_all(spark, d):
    return legacy.sorted_by_height(_lines(spark, d, "true").select("line_no", "value")).select("value", "place")


@query(_ALL_LINES + "SELECT value, row_number() OVER (ORDER BY line_no DESC) AS place FROM lines")
def line_reverse_all(spark, d):
    return legacy.reversed_lines(_lines(spark, d, "true").select("line_no", "value")).select("value", "place")


@query("SELECT l_partkey % 20 AS id, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE l_linenumber END AS prop, l_suppkey % 64 - 32 AS x, l_linenumber AS y, -(l_orderkey % 50) AS z, count(*) AS n FROM lineitem GROUP BY ALL")
def legacy_line_format(spark, d):
    line = F.concat_ws(":", F.col("l_partkey") % 20, F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linenumber").cast("string")), F.concat_ws(".", F.col("l_suppkey") % 64 - 32, "l_linenumber", -(F.col("l_orderkey") % 50)))
    found = legacy.parsed(spark.read.parquet(f"{d}/lineitem.parquet").select(line.alias("value")))
    return found.groupBy("id", "prop", *_place()).agg(F.count("*").alias("n"))


# --- meshes --------------------------------------------------------------------------------------

_FACES = "+sides(dx, dy, dz) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)), faces AS (SELECT v.*, dx, dy, dz FROM vox v, sides s WHERE NOT EXISTS (SELECT 1 FROM vox o WHERE o.x = v.x + dx AND o.y = v.y + dy AND o.z = v.z + dz)) "
#: Corner offsets by normal, as SQL, to be unnested.
_CORNERS = "corner(dx, dy, dz, k, cx, cy, cz) AS (VALUES " + ", ".join(f"({n[0]},{n[1]},{n[2]},{k},{c[0]},{c[1]},{c[2]})" for n, cs in mesh.CORNERS.items() for k, c in enumerate(cs)) + ")"
_VERTEX = f"{_FACES}, {_CORNERS}, points AS (SELECT DISTINCT x + cx AS x, y + cy AS y, z + cz AS z FROM faces JOIN corner USING (dx, dy, dz)), vertex AS (SELECT row_number() OVER (ORDER BY x, y, z) AS vid, x, y, z FROM points) "


@query(_FACES + "SELECT x, y, z, dx, dy, dz FROM faces")
def face_cull(spark, d):
    return neighbors.exposed(vox(spark, d)).select(*_place("dx", "dy", "dz"))


@query(_FACES + f"SELECT {CLASSES['category']} AS category, count(*) AS n FROM faces GROUP BY 1")
def face_cull_by_category(spark, d):
    return classified(neighbors.exposed(vox(spark, d)), "category").groupBy("category").agg(F.count("*").alias("n"))


@query(_VERTEX + "SELECT vid, x, y, z FROM vertex")
def vertex_index(spark, d):
    return mesh.vertices(mesh.faces(vox(spark, d)))


@query(_VERTEX + f"SELECT {CLASSES['category']} AS material, max(CASE WHEN k = 0 THEN vid END) AS v1, max(CASE WHEN k = 1 THEN vid END) AS v2, max(CASE WHEN k = 2 THEN vid END) AS v3, max(CASE WHEN k = 3 THEN vid END) AS v4 FROM faces f JOIN corner USING (dx, dy, dz) JOIN vertex p ON p.x = f.x + cx AND p.y = f.y + cy AND p.z = f.z + cz GROUP BY f.x, f.y, f.z, dx, dy, dz, name")
def quad_index(spark, d):
    quads = stored(mesh.faces(classified(vox(spark, d), "category")), "quads")
    return mesh.indexed(quads, mesh.vertices(quads), "category")


@query(_VERTEX + "SELECT f.x, f.y, f.z, dx, dy, dz, t AS triangle, list_aggregate(list(f.x + cx ORDER BY o), 'sum')::BIGINT AS sx, list_aggregate(list(f.y + cy ORDER BY o), 'sum')::BIGINT AS sy, first(f.z + cz ORDER BY o DESC)::BIGINT AS last_z FROM faces f JOIN corner USING (dx, dy, dz) JOIN (VALUES (0,0,0), (0,1,1), (0,2,2), (1,0,0), (1,1,2), (1,2,3)) AS tri(t, o, k) USING (k) GROUP BY ALL")
def triangles(spark, d):
    at = lambda i: F.col("pos")[i].cast("long")
    tri = mesh.triangles(mesh.faces(vox(spark, d)))
    return tri.select(*_place("dx", "dy", "dz", "triangle"), (at(0) + at(3) + at(6)).alias("sx"), (at(1) + at(4) + at(7)).alias("sy"), at(8).alias("last_z"))


@query("SELECT * FROM (VALUES ('tree_marker', 0.5, 0.0, 0.8), ('foliage_marker', 1.0, 0.0, 0.0), ('leaf', 0.13, 0.55, 0.13), ('wood', 0.4, 0.26, 0.13), ('stumpable', 0.4, 0.4, 0.4), ('other', 0.72, 0.72, 0.72)) AS t(m, r0, g0, b0)".replace("SELECT *", "SELECT m AS material, r0::DOUBLE AS r, g0::DOUBLE AS g, b0::DOUBLE AS b"))
def materials(spark, d):
    return mesh.materials(vox(spark, d).select(F.lit(None).cast("int").alias("building")))


@query(_VERTEX + "SELECT 'v ' || x || ' ' || y || ' ' || z AS line FROM vertex")
def obj_vertex_lines(spark, d):
    quads = stored(mesh.faces(classified(vox(spark, d), "category")), "quads")
    vertex = mesh.vertices(quads)
    lines = mesh.obj_lines(vertex, mesh.indexed(quads, vertex, "category"), "world.mtl")
    return lines.where("part = 1").select("line")


_OBJ = (
    _VERTEX
    + f", quads AS (SELECT {CLASSES['category']} AS material, max(CASE WHEN k = 0 THEN vid END) AS v1, max(CASE WHEN k = 1 THEN vid END) AS v2, max(CASE WHEN k = 2 THEN vid END) AS v3, max(CASE WHEN k = 3 THEN vid END) AS v4 FROM faces f JOIN corner USING (dx, dy, dz) JOIN vertex p ON p.x = f.x + cx AND p.y = f.y + cy AND p.z = f.z + cz GROUP BY f.x, f.y, f.z, dx, dy, dz, name) "
    + "SELECT 0 AS part, '' AS name, 0::BIGINT AS k, 'mtllib world.mtl' AS line UNION ALL SELECT 1, '', vid, 'v ' || x || ' ' || y || ' ' || z FROM vertex UNION ALL SELECT DISTINCT 2, material, -1, 'usemtl ' || material FROM quads UNION ALL SELECT 2, material, v1, 'f ' || v1 || ' ' || v2 || ' ' || v3 || ' ' || v4 FROM quads"
)


@query(_OBJ)
def obj_lines(spark, d):
    """The whole file: its head, vertices, and the quads of each material after its name."""
    quads = stored(mesh.faces(classified(vox(spark, d), "category")), "quads")
    vertex = mesh.vertices(quads)
    return mesh.obj_lines(vertex, mesh.indexed(quads, vertex, "category"), "world.mtl").select("part", "name", "k", "line")


# --- trees ---------------------------------------------------------------------------------------

_NODE = "x::BIGINT * 274877906944 + (z + 33554432)::BIGINT * 4096 + (y + 2048)::BIGINT"
_CELLS = f"+cells AS (SELECT * FROM (SELECT x, y, z, {CLASSES['material']} AS material, {CLASSES['variety']} AS variety, {CLASSES['is_stumpable']} AS is_stumpable, regexp_extract(prop, 'axis=([xyz])', 1) AS axis, {_NODE} AS node FROM vox) WHERE material IS NOT NULL OR is_stumpable), tree AS (SELECT * FROM cells WHERE material IS NOT NULL) "
_PLANAR = "planar AS (SELECT a.node AS src, b.node AS dst FROM tree a JOIN tree b ON a.y = b.y AND a.variety = b.variety AND ((b.x = a.x + 1 AND b.z = a.z) OR (b.x = a.x AND b.z = a.z + 1)))"
_DOWN = "down AS (SELECT a.node AS src, b.node AS dst, a.x, a.z FROM tree a JOIN tree b ON b.y = a.y - 1 AND a.variety = b.variety AND abs(a.x - b.x) + abs(a.z - b.z) <= 1 WHERE a.material = 'leaf' OR a.axis = 'y'), first_down AS (SELECT arg_min(src, (x + 1000) * 10000 + z + 1000) AS src, dst FROM down GROUP BY dst)"
#: Least reachable node of every tree block over the approximate links, then trees with their ground.
_TREES = (
    _CELLS
    + f", {_PLANAR}, {_DOWN}, links AS (SELECT src, dst FROM planar UNION SELECT src, dst FROM first_down), pairs AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), "
    + "walk(node, root) USING KEY (node) AS (SELECT node, node AS root FROM tree UNION SELECT p.b, min(w.root) FROM walk w JOIN pairs p ON p.a = w.node JOIN recurring.walk r ON r.node = p.b WHERE w.root < r.root GROUP BY p.b), "
    + "own AS (SELECT t.*, w.root AS tree_id FROM tree t JOIN walk w USING (node)), "
    + "trees AS (SELECT * FROM own UNION ALL SELECT c.*, o.tree_id FROM cells c JOIN own o ON o.x = c.x AND o.z = c.z AND o.y = c.y + 1 WHERE c.material IS NULL AND o.material IN ('log', 'wood') AND o.axis = 'y'), "
    + "facts AS (SELECT tree_id, bool_or(is_stumpable) AS ground, coalesce(bool_or(material = 'leaf'), false) AS leaf, min(CASE WHEN material IN ('log', 'wood') THEN y END) AS low, min(CASE WHEN material = 'wood' OR (material = 'log' AND axis = 'y') THEN y END) AS firm FROM trees GROUP BY tree_id), "
    + "status AS (SELECT tree_id, CASE WHEN ground AND coalesce(low = firm, false) AND leaf THEN 'keep' WHEN NOT (ground AND coalesce(low = firm, false)) AND leaf THEN 'foliage' ELSE 'discard' END AS status FROM facts) "
)


def _cells(spark, d):
    return stored(trees.relevant(vox(spark, d)), "cells")


@query(_CELLS + "SELECT x, y, z, material, variety, is_stumpable, nullif(axis, '') AS axis FROM cells")
def tree_relevant(spark, d):
    return trees.relevant(vox(spark, d)).select(*_place("material", "variety", "is_stumpable", "axis"))


@query(_CELLS + f", {_PLANAR} SELECT src, dst FROM planar")
def inplane_edges(spark, d):
    return trees.in_plane_edges(_cells(spark, d))


@query(_CELLS + f", {_DOWN} SELECT src, dst FROM first_down")
def adoption_edges_approx(spark, d):
    return trees.adoption_edges_approx(_cells(spark, d))


@query()
def adoption_edges_exact(spark, d):
    return trees.adoption_edges(_cells(spark, d))


@query(_TREES + "SELECT node, tree_id FROM trees", recursive=True)
def tree_components(spark, d):
    return trees.components(_cells(spark, d), exact=False).select("node", "tree_id")


@query()
def tree_components_exact(spark, d):
    return trees.components(_cells(spark, d)).select("node", "tree_id")


@query(_TREES + "SELECT tree_id, status FROM status", recursive=True)
def tree_classify(spark, d):
    return trees.statuses(trees.components(_cells(spark, d), exact=False))


@query(_TREES + "SELECT node, tree_id FROM trees WHERE material IS NULL", recursive=True)
def stump_ground(spark, d):
    return trees.components(_cells(spark, d), exact=False).where("material is null").select("node", "tree_id")


@query(
    _TREES
    + ", logs AS (SELECT t.*, u.is_stumpable AS on_ground FROM trees t LEFT JOIN cells u ON u.x = t.x AND u.z = t.z AND u.y = t.y - 1 WHERE t.material IN ('log', 'wood')), ranked AS (SELECT tree_id, x, y, z, row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN on_ground IS NULL THEN 5 WHEN material = 'log' AND axis = 'y' AND on_ground THEN 1 WHEN material = 'wood' AND on_ground THEN 2 WHEN material = 'log' AND axis = 'y' THEN 3 WHEN material = 'wood' THEN 4 ELSE 5 END, y, x, z) AS rn FROM logs) SELECT tree_id, x, y, z FROM ranked WHERE rn = 1",
    recursive=True,
)
def stump_select(spark, d):
    cells = _cells(spark, d)
    return trees.stumps(trees.components(cells, exact=False), cells)


@query(
    _TREES
    + ", fol AS (SELECT t.* FROM trees t JOIN status USING (tree_id) WHERE status = 'foliage'), kept AS (SELECT t.* FROM trees t JOIN status USING (tree_id) WHERE status = 'keep'), touch AS (SELECT DISTINCT a.tree_id AS a, b.tree_id AS b FROM fol a JOIN fol b ON a.x - b.x BETWEEN -1 AND 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.tree_id <> b.tree_id), near(tree_id) AS (SELECT DISTINCT a.tree_id FROM fol a JOIN kept b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 UNION SELECT t.b FROM near n JOIN touch t ON t.a = n.tree_id) SELECT tree_id FROM near",
    recursive=True,
)
def foliage_attach(spark, d):
    found = trees.components(_cells(spark, d), exact=False)
    status = stored(trees.statuses(found), "status")
    of = lambda s: found.join(apart(status.where(F.col("status") == s).select("tree_id")), "tree_id", "left_semi")
    return trees.attached_foliage(of("keep"), of("foliage"))


@query()
def log_reach(spark, d):
    return trees.reached_logs(trees.components(_cells(spark, d)))


@query(
    _TREES
    + ", logs AS (SELECT tree_id, node, x, y, z, material, axis, material = 'log' AND axis IN ('x', 'z') AS lies FROM trees WHERE material IN ('log', 'wood')), sides(dx, dy, dz) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)), reach(node) AS (SELECT node FROM logs WHERE material = 'wood' OR axis = 'y' UNION SELECT b.node FROM reach r JOIN logs a ON a.node = r.node, sides s JOIN logs b ON b.tree_id = a.tree_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND (NOT a.lies OR dy = 0)) SELECT tree_id, node FROM logs JOIN reach USING (node)",
    recursive=True,
)
def log_reach_approx(spark, d):
    return trees.reached_logs(trees.components(_cells(spark, d), exact=False))


@query(
    _TREES
    + ", boxes AS (SELECT tree_id, min(x) AS x0, min(z) AS z0, least(max(x) - min(x), max(z) - min(z)) + 1 AS least_side FROM trees GROUP BY tree_id), runs AS (SELECT *, max(x) OVER (PARTITION BY tree_id, y, z, island) - x + 1 AS side FROM (SELECT tree_id, x, y, z, material, x - row_number() OVER (PARTITION BY tree_id, y, z ORDER BY x) AS island FROM trees)), starts AS (SELECT r.* FROM runs r JOIN boxes b USING (tree_id) WHERE material IN ('log', 'wood') AND side <= least_side - greatest(x - x0, z - z0)), around AS (SELECT s.tree_id, s.x, s.y, s.z, s.side, count(*) AS n, count(*) FILTER (WHERE t.x BETWEEN s.x AND s.x + side - 1 AND t.z BETWEEN s.z AND s.z + side - 1) AS inside FROM starts s JOIN trees t ON t.tree_id = s.tree_id AND t.y = s.y AND t.x BETWEEN s.x - 1 AND s.x + side AND t.z BETWEEN s.z - 1 AND s.z + side GROUP BY ALL) SELECT DISTINCT tree_id, x, z FROM around WHERE n = side * side AND inside = n",
    recursive=True,
)
def square_cells_approx(spark, d):
    return trees.square_columns(trees.components(_cells(spark, d), exact=False))


@query(
    _TREES
    + ", lying AS (SELECT * FROM trees WHERE material = 'log' AND axis IN ('x', 'z')) SELECT l.tree_id, l.node FROM lying l WHERE NOT EXISTS (SELECT 1 FROM trees o WHERE o.tree_id = l.tree_id AND o.y = l.y AND o.x BETWEEN l.x - 1 AND l.x + 1 AND o.z BETWEEN l.z - 1 AND l.z + 1 AND o.node <> l.node AND (o.axis = '' OR (o.axis <> l.axis AND ((l.axis = 'x' AND o.z = l.z) OR (l.axis = 'z' AND o.x = l.x)))))",
    recursive=True,
)
def axis_check(spark, d):
    return trees.axis_misfits(trees.components(_cells(spark, d), exact=False))


@query()
def axis_check_exact(spark, d):
    return trees.axis_misfits(trees.components(_cells(spark, d)))


@query()
def l_shape_cells(spark, d):
    return trees.l_columns(trees.components(_cells(spark, d)))


@query()
def square_cells(spark, d):
    return trees.square_columns(trees.components(_cells(spark, d)))


@query()
def orphan_split(spark, d):
    found = trees.components(_cells(spark, d)).where("material is not null")
    return trees.split_orphans(found).select("tree_id", "node")


@query(_TREES + "SELECT t.tree_id, t.y, t.x, t.z, v.name || ':' || v.prop || ':' || t.x || '.' || t.y || '.' || t.z AS line FROM trees t JOIN vox v USING (x, y, z)", recursive=True)
def tree_dump(spark, d):
    return trees.tree_lines(trees.components(_cells(spark, d), exact=False), vox(spark, d))


@query()
def tree_rewrite(spark, d):
    return trees.remove_trees(vox(spark, d))


# --- buildings -----------------------------------------------------------------------------------

_NAMED = f"+named AS (SELECT x, y, z, name, {CLASSES['is_natural']} AS is_natural, {CLASSES['is_discardable']} AS is_discardable, {_NODE} AS node FROM vox) "
_PLANES = (
    _NAMED
    + ", man AS (SELECT * FROM named WHERE NOT is_natural), meet AS (SELECT a.node AS a, b.node AS b FROM man a JOIN man b ON b.y = a.y AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.node <> b.node), "
    + "grow(node, root) USING KEY (node) AS (SELECT node, node AS root FROM man UNION SELECT m.b, min(g.root) FROM grow g JOIN meet m ON m.a = g.node JOIN recurring.grow r ON r.node = m.b WHERE g.root < r.root GROUP BY m.b), "
    + "claims AS (SELECT m.x, m.y, m.z, m.name, m.is_natural, m.is_discardable, g.root AS comp FROM man m JOIN grow g USING (node)) "
)
_KEPT = (
    _PLANES
    + ", uniform AS (SELECT comp FROM claims GROUP BY comp HAVING min(name) = max(name) AND bool_and(is_discardable)), k1 AS (SELECT * FROM claims WHERE comp NOT IN (SELECT comp FROM uniform)), tiny AS (SELECT comp FROM k1 GROUP BY comp HAVING min(name) = max(name) AND count(*) <= 5), kept AS (SELECT * FROM k1 WHERE comp NOT IN (SELECT comp FROM tiny)) "
)
_MET = "way(dx, dy, dz) AS (VALUES (1,0,0), (0,1,0), (0,0,1)), touch AS (SELECT DISTINCT least(a.comp, b.comp) AS a, greatest(a.comp, b.comp) AS b FROM kept a, way w JOIN kept b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.comp <> b.comp)"
_BETWEEN = "free AS (SELECT x, y, z FROM vox EXCEPT SELECT x, y, z FROM kept), between AS (SELECT DISTINCT f.x, f.y, f.z, least(a.comp, b.comp) AS a, greatest(a.comp, b.comp) AS b FROM free f, way w JOIN kept a ON a.x = f.x + dx AND a.y = f.y + dy AND a.z = f.z + dz JOIN kept b ON b.x = f.x - dx AND b.y = f.y - dy AND b.z = f.z - dz WHERE a.comp <> b.comp)"
_MERGED = (
    _KEPT
    + f", {_MET}, {_BETWEEN}, bonds AS (SELECT a, b FROM touch UNION SELECT b, a FROM touch UNION SELECT a, b FROM between UNION SELECT b, a FROM between), "
    + "join_up(comp, root) USING KEY (comp) AS (SELECT DISTINCT comp, comp AS root FROM kept UNION SELECT o.b, min(j.root) FROM join_up j JOIN bonds o ON o.a = j.comp JOIN recurring.join_up r ON r.comp = o.b WHERE j.root < r.root GROUP BY o.b), "
    + "labels AS (SELECT comp, dense_rank() OVER (ORDER BY root) - 1 AS building_id FROM join_up), "
    + "found AS (SELECT building_id, x, y, z, false AS absorbed FROM kept JOIN labels USING (comp) UNION ALL SELECT min(building_id), x, y, z, true FROM between JOIN labels ON labels.comp = between.a GROUP BY x, y, z) "
)


def _named(spark, d):
    return stored(classified(vox(spark, d), "is_natural", "is_discardable"), "named")


def _claims(spark, d):
    """In-plane components, as if they were whole components: for the steps after the search."""
    named = _named(spark, d)
    return named, stored(named.join(apart(buildings.plane_components(named).withColumnRenamed("plane", "comp")), ["x", "y", "z"]), "claims")


def _kept(spark, d):
    named, claims = _claims(spark, d)
    return named, buildings.kept(claims)


@query(_PLANES + "SELECT x, y, z, comp AS plane FROM claims", recursive=True)
def plane_cc8(spark, d):
    return buildings.plane_components(_named(spark, d))


@query(_PLANES + "SELECT DISTINCT comp, x + dx AS x, y - 1 AS y, z + dz AS z FROM claims, (VALUES (-1), (0), (1)) AS p(dx), (VALUES (-1), (0), (1)) AS q(dz) WHERE y = 0", recursive=True)
def below_footprint(spark, d):
    return buildings.below(_claims(spark, d)[1].where("y = 0"))


@query(_PLANES + "SELECT DISTINCT comp, x + dx AS x, y - 1 AS y, z + dz AS z FROM claims, (VALUES (-1), (0), (1)) AS p(dx), (VALUES (-1), (0), (1)) AS q(dz)", recursive=True)
def below_footprint_all(spark, d):
    return buildings.below(_claims(spark, d)[1])


@query()
def building_raw(spark, d):
    return buildings.raw_components(_named(spark, d))


@query(_PLANES + "SELECT comp FROM claims GROUP BY comp HAVING min(name) = max(name) AND bool_and(is_discardable)", recursive=True)
def discard_uniform(spark, d):
    return buildings.uniform_discards(_claims(spark, d)[1])


@query(_PLANES + "SELECT comp FROM claims GROUP BY comp HAVING min(name) = max(name) AND count(*) <= 5", recursive=True)
def discard_tiny(spark, d):
    return buildings.tiny_discards(_claims(spark, d)[1])


@query(_KEPT + f", {_MET} SELECT a, b FROM touch", recursive=True)
def touch_pairs(spark, d):
    return buildings.touching(_kept(spark, d)[1])


@query(_KEPT + f", {_MET}, {_BETWEEN} SELECT x, y, z, a, b FROM between", recursive=True)
def sandwich_pairs(spark, d):
    named, kept = _kept(spark, d)
    return buildings.sandwiched(kept, named)


@query(_MERGED + "SELECT building_id, x, y, z, absorbed FROM found", recursive=True)
def building_merge(spark, d):
    named, kept = _kept(spark, d)
    return buildings.merged(kept, named)


@query(_MERGED + "SELECT v.x, v.y, v.z, CASE WHEN building_id IS NULL THEN name ELSE 'building_marker' END AS name, building_id FROM vox v LEFT JOIN found USING (x, y, z)", recursive=True)
def building_rewrite(spark, d):
    named, kept = _kept(spark, d)
    return buildings.marked(vox(spark, d), buildings.merged(kept, named)).select(*_place("name", "building_id"))


@query(
    _MERGED
    + "SELECT (SELECT count(*) FROM vox) AS blocks, (SELECT count(DISTINCT comp) FROM claims) AS components, (SELECT count(*) FROM uniform) AS uniform, (SELECT count(*) FROM tiny) AS tiny, (SELECT count(DISTINCT building_id) FROM found) AS buildings, (SELECT count(*) FROM found) AS marked",
    recursive=True,
)
def building_counters(spark, d):
    """The numbers of discards and merges, from in-plane components as if they were whole ones."""
    counters = buildings.Counters()
    named = stored(counters.on(classified(vox(spark, d), "is_natural", "is_discardable"), blocks=F.count("*")), "named")
    claims = stored(named.join(apart(buildings.plane_components(named).withColumnRenamed("plane", "comp")), ["x", "y", "z"]), "claims")
    buildings.from_claims(named, claims, counters)
    return counters.row()


@query()
def building_search_counters(spark, d):
    """The numbers of a whole search."""
    counters = buildings.Counters()
    buildings.find_buildings(vox(spark, d), counters)
    return counters.row()


@query()
def building_search(spark, d):
    return buildings.find_buildings(vox(spark, d))


# --- reports -------------------------------------------------------------------------------------


def _structures(spark, d):
    """Columns of 16x16 as buildings: for the steps of the report."""
    rows = vox(spark, d).where("name in ('oak_planks', 'oak_stairs', 'glass', 'grass_block')")
    owner = (codec.chunk_of(F.col("x")) + 3) * 6 + codec.chunk_of(F.col("z")) + 3
    return report.structure_blocks(rows.select("x", "y", "z", owner.alias("building_id")), vox(spark, d))


_STRUCTURES = f"+parts AS (SELECT CAST((floor(x / 16.0) + 3) * 6 + floor(z / 16.0) + 3 AS INT) AS building_id, x, y, z, name, prop, {CLASSES['shape']} AS shape, {CLASSES['color']} AS color, {CLASSES['top_color']} AS top_color FROM vox WHERE name IN ('oak_planks', 'oak_stairs', 'glass', 'grass_block')) "


@query(_STRUCTURES + "SELECT building_id, x, y, z, name, prop, shape, color, top_color FROM parts")
def structure_join(spark, d):
    return _structures(spark, d).select("building_id", *_place("name", "prop", "shape", "color", "top_color"))


@query(_STRUCTURES + "SELECT building_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) AS n FROM parts GROUP BY building_id")
def structure_bbox(spark, d):
    return report.boxes(_structures(spark, d))


@query(_STRUCTURES + ", sides(dx, dy, dz) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) SELECT building_id, x, y, z, dx, dy, dz, CASE WHEN dy = 1 AND top_color IS NOT NULL THEN top_color ELSE color END AS face_color FROM parts p, sides s WHERE shape = 'cube' AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.shape = 'cube' AND o.building_id = p.building_id AND o.x = p.x + dx AND o.y = p.y + dy AND o.z = p.z + dz)")
def structure_faces(spark, d):
    return report.structure_faces(_structures(spark, d)).select("building_id", *_place("dx", "dy", "dz", "face_color"))


@query(
    _STRUCTURES
    + ", own AS (SELECT building_id, 1 / 3.0::DOUBLE + ((building_id::BIGINT * 618034) % 1000003) / 1000002.0::DOUBLE / 3 AS hue FROM (SELECT DISTINCT building_id FROM parts)), shade AS (SELECT *, 0.855::DOUBLE AS chroma, 0.095::DOUBLE AS low, 0.855::DOUBLE * (1 - abs((hue * 6) % 2 - 1)) + 0.095::DOUBLE AS other FROM own) "
    + "SELECT 'building_' || building_id AS material, round(low, 6) AS r, round(CASE WHEN hue < 0.5 THEN chroma + low ELSE other END, 6) AS g, round(CASE WHEN hue < 0.5 THEN other ELSE chroma + low END, 6) AS b FROM shade"
)
def building_materials(spark, d):
    """Each building's own material, beside the fixed ones of materials."""
    found = mesh.materials(_structures(spark, d).select(F.col("building_id").alias("building"))).where("material like 'building%'")
    return found.select("material", *[F.round(c, 6).alias(c) for c in "rgb"])


_SIDES = "sides(dx, dy, dz) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))"
_SHOWN = f"{_SIDES}, shown AS (SELECT building_id, x, y, z, dx, dy, dz, CASE WHEN dy = 1 AND top_color IS NOT NULL THEN top_color ELSE color END AS face_color FROM parts p, sides s WHERE shape = 'cube' AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.shape = 'cube' AND o.building_id = p.building_id AND o.x = p.x + dx AND o.y = p.y + dy AND o.z = p.z + dz))"
_TRI = "tri(t, o, k) AS (VALUES (0,0,0), (0,1,1), (0,2,2), (1,0,0), (1,1,2), (1,2,3))"
_TILES = ", ".join(f"CAST(floor({c} / 16.0) AS INT) AS tile_{c}" for c in "xyz")


def _json_sql(keys: str = "", tiles: str = "") -> str:
    """Structures as JSON text; keys: further columns that structures are kept apart by, tiles: how they come about."""
    order = "ORDER BY x, y, z, dx, dy, dz, t, o"
    kept = "k IN ('axis', 'half', 'powered')"
    return (
        _STRUCTURES
        + f", {_SHOWN}, {_CORNERS}, {_TRI}, points AS (SELECT building_id, face_color, f.x, f.y, f.z, dx, dy, dz, t, o, (f.x + cx) || ',' || (f.y + cy) || ',' || (f.z + cz) AS p, dx || ',' || dy || ',' || dz AS q{tiles.replace('(x', '(f.x').replace('(y', '(f.y').replace('(z', '(f.z')} FROM shown f JOIN corner USING (dx, dy, dz) JOIN tri USING (k)), "
        + f"mesh AS (SELECT building_id{keys}, face_color, '{{\"color\":\"' || face_color || '\",\"pos\":[' || string_agg(p, ',' {order}) || '],\"nrm\":[' || string_agg(q, ',' {order}) || ']}}' AS m FROM points GROUP BY building_id{keys}, face_color), "
        + f"meshes AS (SELECT building_id{keys}, string_agg(m, ',' ORDER BY face_color) AS m FROM mesh GROUP BY ALL), "
        + f"pairs AS (SELECT building_id, x, y, z, split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v FROM (SELECT building_id, x, y, z, unnest(string_split(prop, ',')) AS kv FROM parts WHERE shape <> 'cube')), "
        + f"own AS (SELECT building_id, x, y, z, '\"p\":{{' || string_agg('\"' || k || '\":\"' || v || '\"', ',' ORDER BY k) || '}}' AS p FROM pairs WHERE {kept} GROUP BY building_id, x, y, z), "
        + f"lone AS (SELECT *{tiles}, '{{\"x\":' || x || ',\"y\":' || y || ',\"z\":' || z || ',\"n\":\"' || name || '\",\"s\":\"' || shape || '\",\"c\":\"' || color || '\"' || coalesce(',\"t\":\"' || top_color || '\"', '') || coalesce(',' || p, '') || '}}' AS b FROM parts LEFT JOIN own USING (building_id, x, y, z) WHERE shape <> 'cube'), "
        + f"blocks AS (SELECT building_id{keys}, string_agg(b, ',' ORDER BY x, y, z) AS b FROM lone GROUP BY ALL), "
        + f"boxes AS (SELECT building_id{keys}, min(x) || ',' || min(y) || ',' || min(z) || ',' || max(x) || ',' || max(y) || ',' || max(z) AS box, count(*) AS n FROM (SELECT *{tiles} FROM parts) GROUP BY ALL) "
        + f"SELECT building_id AS id{keys}, '{{\"id\":' || building_id || ',\"blocks\":[' || coalesce(b, '') || '],\"cubeMeshes\":[' || coalesce(m, '') || '],\"bbox\":[' || box || '],\"count\":' || n || '}}' AS json FROM boxes LEFT JOIN blocks USING (building_id{keys}) LEFT JOIN meshes USING (building_id{keys})"
    )


@query(_json_sql())
def structure_json(spark, d):
    return report.as_json(_structures(spark, d))


@query(_json_sql(", tile_x, tile_y, tile_z", f", {_TILES}"))
def structure_tiles(spark, d):
    return report.tiles(_structures(spark, d)).select("id", "tile_x", "tile_y", "tile_z", F.to_json(F.struct("id", "blocks", "cubeMeshes", "bbox", "count")).alias("json"))


@query("SELECT k, comp FROM (SELECT l_partkey AS k, 0 AS comp FROM lineitem WHERE false)")
def empty_components(spark, d):
    none = spark.read.parquet(f"{d}/lineitem.parquet").where("false").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return connected_components(none).select(F.col("node").alias("k"), F.col("component").cast("int").alias("comp"))

