"""Queries of the tiling operators with their twins in SQL: geometry, partitioning, levels of detail, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.operators import grouping, hierarchy, ifc_model, kdtree, nested, tiles
from geostrata.plans import pipelines as P
from geostrata.queries import views as V
from geostrata.queries.p_core import NESTED
from geostrata.runtime import read, row_numbers, stored

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, without minus zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


W_SOUP = "WITH " + V.SOUP

# --- boxes and centers


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.soup(spark, sf_dir).withColumn("box", G.bbox(F.col("tri")))


@query(W_SOUP + " SELECT id, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM verts GROUP BY id")
def feature_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("id", "box.*")


@query(W_SOUP + " SELECT id, round((min(x) + max(x)) / 2, 6) + 0.0 AS cx, round((min(y) + max(y)) / 2, 6) + 0.0 AS cy, round((min(z) + max(z)) / 2, 6) + 0.0 AS cz FROM verts GROUP BY id")
def feature_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.center(F.col("box"))
    return rounded(_boxed(spark, sf_dir).select("id", c["x"].alias("cx"), c["y"].alias("cy"), c["z"].alias("cz")))


# --- kd-tree and tiles

KD = """, kd AS (
  SELECT ord, x, y, z, '' AS path, (SELECT count(*) FROM v_points) AS size, true AS split, 0 AS depth FROM v_points
  UNION ALL
  SELECT ord, x, y, z, path || CASE WHEN r > size // 2 THEN '1' ELSE '0' END, CASE WHEN r > size // 2 THEN size - size // 2 ELSE size // 2 END, size - size // 2 > {most}, depth + 1
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN depth % 2 = 0 THEN x ELSE y END, CASE WHEN depth = 0 THEN 0 WHEN depth % 2 = 0 THEN y ELSE x END, ord) AS r FROM kd WHERE split) q),
leaf AS (SELECT ord, x, y, z, CAST(dense_rank() OVER (ORDER BY path) - 1 AS INTEGER) AS tile FROM kd WHERE NOT split)"""


def _kd_sql(most: int) -> str:
    return V.ctes("v_points") + KD.replace("{most}", str(most))


def _tiled(spark: SparkSession, sf_dir: str, most: int = kdtree.DEFAULT_MAX) -> DataFrame:
    t = kdtree.kd_tree(V.view(spark, sf_dir, "v_points"), most).withColumn("tile", F.col("tile").cast("int"))
    box = F.struct(*[F.col(k).alias(k + n) for n in ("min", "max") for k in G.AXES])
    return t.withColumn("box", box)


@query(_kd_sql(500) + " SELECT ord, tile FROM leaf")
def kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir).select("ord", "tile")


@query(_kd_sql(20) + " SELECT ord, tile FROM leaf")
def kd_tree_small_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, 20).select("ord", "tile")


@query(_kd_sql(500) + " SELECT tile, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax, count(*) AS n_features FROM leaf GROUP BY tile")
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.tile_boxes(_tiled(spark, sf_dir))


@query(_kd_sql(500) + " , c AS (SELECT tile, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM leaf GROUP BY tile) SELECT round(avg(cx), 4) AS cx, round(avg(cy), 4) AS cy, round(avg(cz), 4) AS cz FROM c")
def tree_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grouping.tree_centroid(grouping.tile_centroids(_tiled(spark, sf_dir))), 4)


@query(
    _kd_sql(100)
    + """ SELECT tile AS tile_index, count(*) AS n_features, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, round(avg(x) + 100, 4) AS tx, round(avg(y) + 100, 4) AS ty, round(avg(z) + 200, 4) AS tz
  FROM leaf GROUP BY tile"""
)
def tileset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: points into tiles with box, translation and number."""
    t = _tiled(spark, sf_dir, 100)
    b, c = grouping.tile_boxes(t), grouping.tile_centroids(t)
    out = b.join(c, "tile").select(F.col("tile").alias("tile_index"), "n_features", "xmin", "xmax", "ymin", "ymax", (F.col("cx") + 100).alias("tx"), (F.col("cy") + 100).alias("ty"), (F.col("cz") + 200).alias("tz"))
    return rounded(out, 4)


@query(_kd_sql(1_000_000_000) + " SELECT ord, tile FROM leaf")
def kd_tree_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split: a set below the maximum is still halved once."""
    return _tiled(spark, sf_dir, 1_000_000_000).select("ord", "tile")


@query(W_SOUP + " SELECT vec_id AS ord, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS group_id FROM embeddings")
def group_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.soup(spark, sf_dir).withColumn("ord", F.col("id"))
    return tiles.partitioned(f, as_lods=True).select("ord", F.col("tile").alias("group_id"))


def _ifc(grouped_by: str, name: str) -> tuple:
    sql = f"SELECT object_id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS group_id FROM (SELECT object_id, min(object_id) OVER (PARTITION BY {name}) AS first FROM ifcobjectgeom)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = read(spark, sf_dir, "ifcobjectgeom")
        one = F.array(F.struct(*[G.point(i, j, 0).alias(k) for k, (i, j) in zip("abc", ((0, 0), (1, 0), (0, 1)), strict=True)]))
        f = o.select(F.col("object_id").alias("ord"), ifc_model.group_key(o, grouped_by).alias("key_of"), one.alias("tri"))
        return tiles.partitioned(f, group="key_of").select(F.col("ord").alias("object_id"), F.col("tile").alias("group_id"))

    return run, sql


for _name, _by, _text in (
    ("group_by_class", "IfcTypeObject", "coalesce(classe, 'None')"),
    ("ifc_by_group", "IfcGroup", "coalesce(ifc_group, 'None')"),
    ("ifc_by_space", "IfcSpace", "coalesce(CASE WHEN classe = 'IfcSpace' THEN coalesce(object_name, guid) ELSE ifc_space END, 'None')"),
):
    QUERIES[_name], SQL[_name] = _ifc(_by, _text)


@query(r"""WITH p AS (SELECT guid, pset_name, min(row_no) AS first, '[' || coalesce(CAST(to_json(pset_name) AS VARCHAR), 'null') || ',' || string_agg('[' || CAST(to_json(prop_name) AS VARCHAR) || ',' || coalesce(CAST(to_json(prop_value) AS VARCHAR), 'null') || ']', ',' ORDER BY row_no) || ']' AS s
  FROM ifc_property WHERE guid IS NOT NULL AND prop_name IS NOT NULL GROUP BY 1, 2) SELECT guid, '[' || string_agg(s, ',' ORDER BY first) || ']' AS properties FROM p GROUP BY 1""")
def ifc_property_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export rows as property sets of each object."""
    return ifc_model.property_sets(read(spark, sf_dir, "ifc_property"))


ROW_LINKS = "WITH RECURSIVE b AS (SELECT id, building_parent_id AS parent FROM building WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_modified_at DESC NULLS LAST, loaded_at DESC NULLS LAST, building_parent_id DESC NULLS LAST, building_root_id DESC NULLS LAST) = 1)"


@query(
    ROW_LINKS
    + """, w AS (SELECT id, id AS pos, 0 AS step, [id] AS seen, false AS closed FROM b UNION ALL SELECT w.id, p.id, step + 1, list_append(seen, p.id), list_contains(seen, p.id) FROM w JOIN b o ON o.id = w.pos JOIN b p ON p.id = o.parent WHERE NOT closed)
  SELECT id, CAST(step AS INTEGER) AS step, pos AS ancestor_id FROM w WHERE step > 0 AND id NOT IN (SELECT id FROM w WHERE closed)"""
)
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor of every building part, from the next one up."""
    return ifc_model.ancestor_chain(hierarchy.buildings(read(spark, sf_dir, "building")))


# --- zones and cells

ZONES = (
    V.ctes("v_points", "v_zones")
    + """, inside AS (SELECT p.ord, min(z.zone_id) AS zone_id FROM v_points p JOIN v_zones z ON abs(CAST(round(p.x * 10000) AS BIGINT) - CAST(round(z.cx * 10000) AS BIGINT)) + abs(CAST(round(p.y * 10000) AS BIGINT) - CAST(round(z.cy * 10000) AS BIGINT)) < 15000000 GROUP BY 1)"""
)


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.view(spark, sf_dir, "v_points").withColumn("feature_id", F.col("ord"))
    return grouping.zones_first_match(p, V.zones(spark, sf_dir))


@query(ZONES + " SELECT p.ord, i.zone_id FROM v_points p JOIN inside i ON i.ord = p.ord")
def zone_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned(spark, sf_dir).filter("zone_id is not null").select("ord", "zone_id")


@query(ZONES + " SELECT p.ord FROM v_points p LEFT JOIN inside i ON i.ord = p.ord WHERE i.ord IS NULL")
def zone_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned(spark, sf_dir).filter("zone_id is null").select("ord")


@query(
    V.ctes("v_points")
    + """, g AS (SELECT ord AS group_id, round_even(x / 1000, 0) * 1000 + 0.0 AS cell_x, round_even(y / 1000, 0) * 1000 + 0.0 AS cell_y, round_even(z / 1000, 0) * 1000 + 0.0 AS cell_z FROM v_points)
  SELECT *, min(group_id) OVER (PARTITION BY cell_x, cell_y, cell_z) AS merged_id FROM g"""
)
def grid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grid_merge(V.view(spark, sf_dir, "v_points").withColumn("group_id", F.col("ord")))


@query(
    _kd_sql(100)
    + """, m AS (SELECT l.tile, v.klass, min(l.ord) AS f FROM leaf l JOIN v_points v ON v.ord = l.ord GROUP BY 1, 2)
  SELECT tile, klass, CAST(row_number() OVER (PARTITION BY tile ORDER BY f) - 1 AS INTEGER) AS new_index FROM m"""
)
def palette_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.compact_palette(_tiled(spark, sf_dir, 100), "tile", "klass", "ord")


# --- levels of detail

CHAIN = ", chain AS (SELECT * FROM (VALUES (0, 'loa', 20.0, 1), (1, 'lod1', 5.0, 1), (2, 'texture_lod', 13 / 3 + 1.0, 13), (3, 'texture_lod', 2.0, 3), (4, 'leaf', 1.0, 1)) t(depth, kind, geometric_error, downsample))"


@query(_kd_sql(100) + CHAIN + " SELECT DISTINCT l.tile AS group_id, c.depth, c.kind, round(CAST(c.geometric_error AS DOUBLE), 6) AS geometric_error, c.downsample FROM leaf l, chain c")
def lod_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _tiled(spark, sf_dir, 100).select(F.col("tile").alias("group_id")).distinct()
    return rounded(grouping.lod_nodes(groups, 2, lod1=True, loa=True))


@query(_kd_sql(100) + CHAIN + " SELECT DISTINCT l.tile AS group_id, c.depth, l.tile * 5 + c.depth AS tile_index FROM leaf l, chain c")
def tile_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _tiled(spark, sf_dir, 100).select(F.col("tile").alias("group_id")).distinct()
    n = grouping.number_tiles(grouping.lod_nodes(groups, 2, lod1=True, loa=True))
    return n.select("group_id", "depth", F.col("tile_index").cast("int").alias("tile_index"))


@query("""SELECT n_nationkey AS group_id, CAST(max(n_nationkey) OVER () - n_nationkey AS INTEGER) AS depth, lead(n_nationkey) OVER (ORDER BY n_nationkey) AS parent_id,
  CAST(CASE n_nationkey WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 13 ELSE 1 END AS DOUBLE) AS geometric_error FROM nation""")
def vertical_lods(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grouping.vertical_lods(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id")), (1.0, 5.0, 13.0))
    return v.withColumn("depth", F.col("depth").cast("int"))


@query(NESTED + " SELECT record_id, node_path, '0.' || (row_number() OVER (ORDER BY record_id, CAST(split_part(node_path, '.', 2) AS INTEGER)) - 1) AS merged_path FROM tiles WHERE depth = 1")
def merge_tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of all tilesets' roots below one root."""
    return tiles.merged_children(read(spark, sf_dir, "tileset"))


@query(NESTED + ", n AS (SELECT record_id, parent_path, count(*) AS n FROM tiles GROUP BY 1, 2) SELECT t.record_id, t.node_path, coalesce(n, 0) AS n_children, t.parent_path = '' AS is_root, n IS NULL AS is_leaf FROM tiles t LEFT JOIN n ON n.record_id = t.record_id AND n.parent_path = t.node_path")
def tile_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, leaves and inner tiles of every tileset."""
    return tiles.tree_places(nested.tiles(nested.tile_columns(read(spark, sf_dir, "tileset"))))


@query(W_SOUP + " SELECT id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, CAST(0 AS DOUBLE) AS z FROM verts GROUP BY id")
def plane_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.soup(spark, sf_dir).select("id", G.plane_mean(G.corners(F.col("tri"))).alias("m")).select("id", "m.*"))


@query(
    V.ctes("v_foot", "v_zones")
    + """, m AS (SELECT f.id, f.z, f.height, min(z.zone_id) AS zone_id FROM v_foot f JOIN v_zones z ON abs(CAST(round((gx + w / 2) * 10000) AS BIGINT) - CAST(round(cx * 10000) AS BIGINT)) + abs(CAST(round((gy + d / 2) * 10000) AS BIGINT) - CAST(round(cy * 10000) AS BIGINT)) < 15000000 GROUP BY 1, 2, 3)
  SELECT CAST(zone_id AS BIGINT) AS zone_id, count(*) * 0 + 10 AS n_tri, min(z) AS low, round(avg(z + height), 6) AS high FROM m GROUP BY 1"""
)
def loa_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each zone with members: from their lowest point to the mean of their triangles' tops."""
    f = V.footprints(spark, sf_dir).withColumn("tri", G.walls(F.col("ring"), F.col("height"))).withColumn("ord", F.col("id"))
    zones = V.zones(spark, sf_dir)
    b = tiles.loa(stored(tiles.partitioned(stored(f.select("ord", "id", "tri")), zones)).filter("zone_id is not null"), zones)
    return rounded(b.select(F.col("ord").alias("zone_id"), F.size("tri").cast("bigint").alias("n_tri"), G.min_z(F.col("tri")).alias("low"), F.array_max(F.transform(G.corners(F.col("tri")), lambda p: p["z"])).alias("high")))


# --- transforms

V_OUT = "id, tri_no, corner"


@query(W_SOUP + f" SELECT {V_OUT}, round(x + 100, 6) AS x, round(y - 50, 6) AS y, round(z + 7, 6) AS z FROM verts")
def translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.soup(spark, sf_dir).withColumn("tri", G.translate(F.col("tri"), F.lit(100.0), F.lit(-50.0), F.lit(7.0)))
    return rounded(V.flat(f, "id"))


@query(
    W_SOUP
    + f""", b AS (SELECT id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM verts GROUP BY id)
  SELECT v.id, tri_no, corner, round((x - cx) * 10 + cx, 6) + 0.0 AS x, round((y - cy) * 10 + cy, 6) + 0.0 AS y, round((z - cz) * 10 + cz, 6) + 0.0 AS z FROM verts v JOIN b ON b.id = v.id"""
)
def scale_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _boxed(spark, sf_dir).withColumn("c", G.center(F.col("box")))
    return rounded(V.flat(f.withColumn("tri", G.scale_about(F.col("tri"), F.lit(10.0), F.col("c"))), "id"))


@query(W_SOUP + f" SELECT {V_OUT}, x, y, round(z * 0.3048006096, 6) + 0.0 AS z FROM verts")
def height_mult(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.soup(spark, sf_dir).withColumn("tri", G.multiply_height(F.col("tri"), F.lit(0.3048006096)))
    return rounded(V.flat(f, "id"))


@query(W_SOUP + f" SELECT {V_OUT}, x, z AS y, 0.0 - y + 0.0 AS z FROM verts")
def y_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.flat(V.soup(spark, sf_dir).withColumn("tri", G.y_up(F.col("tri"))), "id"))


@query(
    W_SOUP
    + """, t AS (SELECT id, id % 7 AS tile, tri_no, corner, x, y, z * 2 AS z FROM verts),
  b AS (SELECT id, any_value(tile) AS tile, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM t GROUP BY id),
  c AS (SELECT tile, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz FROM b GROUP BY tile), m AS (SELECT avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz FROM c),
  s AS (SELECT id, tile, tri_no, corner, (x - mx) * 3 + mx AS x, (y - my) * 3 + my AS y, (z - mz) * 3 + mz AS z FROM t, m),
  b2 AS (SELECT id, any_value(tile) AS tile, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM s GROUP BY id),
  c2 AS (SELECT tile, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz FROM b2 GROUP BY tile)
  SELECT s.id, tri_no, corner, round(x - cx, 4) + 0.0 AS x, round(y - cy, 4) + 0.0 AS y, round(z - cz, 4) + 0.0 AS z, round(cx + 100, 4) AS tx, round(cy + 100, 4) AS ty, round(cz + 200, 4) AS tz FROM s JOIN c2 ON c2.tile = s.tile"""
)
def node_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.soup(spark, sf_dir).withColumn("tile", F.col("id") % 7)
    return rounded(V.flat(grouping.node_transform(f, "tile", 2.0, 3.0, (100.0, 100.0, 200.0)), "id", "tx", "ty", "tz"), 4)


@query(
    W_SOUP
    + """, t AS (SELECT id, tri_no, max(CASE corner WHEN 0 THEN x END) AS ax, max(CASE corner WHEN 0 THEN y END) AS ay, max(CASE corner WHEN 0 THEN z END) AS az,
    max(CASE corner WHEN 1 THEN x END) AS bx, max(CASE corner WHEN 1 THEN y END) AS by_, max(CASE corner WHEN 1 THEN z END) AS bz,
    max(CASE corner WHEN 2 THEN x END) AS cx, max(CASE corner WHEN 2 THEN y END) AS cy, max(CASE corner WHEN 2 THEN z END) AS cz FROM verts GROUP BY 1, 2),
  n AS (SELECT id, tri_no, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM t)
  SELECT id, tri_no, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nz FROM n"""
)
def triangle_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.soup(spark, sf_dir).select("id", F.posexplode("tri").alias("tri_no", "t"))
    n = G.normal(F.col("t"))
    return rounded(t.select("id", "tri_no", n["x"].alias("nx"), n["y"].alias("ny"), n["z"].alias("nz")))


@query(
    W_SOUP
    + " , t AS (SELECT id, tri_no, max(z) AS top, min(z) AS low FROM verts GROUP BY 1, 2) SELECT id, min(low) AS min_z, round(avg(top), 6) AS mean_max_z FROM t GROUP BY id"
)
def height_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.soup(spark, sf_dir).select("id", G.min_z(F.col("tri")).alias("min_z"), G.mean_max_z(F.col("tri")).alias("mean_max_z")))


# --- projections: the same closed formula with as many rounds

CONIC = f"""SELECT ord, 1843000 + x AS px, 5174000 + y AS py, z FROM v_points), a AS (
  SELECT *, px - 1700000.0 AS dx, {G.RADIUS0!r} - (py - 5200000.0) AS dy FROM p), b AS (
  SELECT *, atan2(dx, dy) / {G.CONE!r} AS lon, power(sqrt(dx * dx + dy * dy) / {G.GRS80_A * G.FACTOR!r}, {1 / G.CONE!r}) AS t FROM a), l0 AS (SELECT *, pi() / 2 - 2 * atan(t) AS lat FROM b)"""


def _rounds() -> str:
    out = "WITH RECURSIVE v_points AS (" + V.TEXT["v_points"] + "), p AS (" + CONIC
    for i in range(6):
        out += f", l{i + 1} AS (SELECT * EXCLUDE (lat), pi() / 2 - 2 * atan(t * power((1 - {G.E!r} * sin(lat)) / (1 + {G.E!r} * sin(lat)), {G.E / 2!r})) AS lat FROM l{i})"
    return out + f", g AS (SELECT ord, z, degrees(lat) AS lat, degrees(lon) + 3.0 AS lon FROM l6)"


def _moved(spark: SparkSession, sf_dir: str, to: str, names: tuple[str, str, str]) -> DataFrame:
    p = V.view(spark, sf_dir, "v_points")
    out = G.reproject(F.col("x") + 1843000, F.col("y") + 5174000, F.col("z"), "EPSG:3946", to)
    return p.select("ord", *[c.alias(n) for c, n in zip(out, names, strict=True)])


@query(_rounds() + " SELECT ord, round(lat, 6) AS lat, round(lon, 6) AS lon, z AS h FROM g")
def reproject_cc46_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_moved(spark, sf_dir, "EPSG:4171", ("lat", "lon", "h")))


@query(
    _rounds()
    + f""", n AS (SELECT *, radians(lat) AS p, radians(lon) AS q, {G.GRS80_A!r} / sqrt(1 - {G.E2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM g)
  SELECT ord, round((n + z) * cos(p) * cos(q), 3) AS x, round((n + z) * cos(p) * sin(q), 3) AS y, round((n * {1 - G.E2!r} + z) * sin(p), 3) AS z FROM n"""
)
def reproject_geocentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_moved(spark, sf_dir, "EPSG:4978", ("x", "y", "z")), 3)


@query(_rounds() + f" SELECT ord, round({G.GRS80_A!r} * radians(lon), 3) AS x, round({G.GRS80_A!r} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, z FROM g")
def reproject_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_moved(spark, sf_dir, "EPSG:3857", ("x", "y", "z")), 3)


# --- rings, heights, walls of the GeoJSON features


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, ring): the first ring of each building, points in the order given."""
    g = read(spark, sf_dir, "geojson").filter("layer = 'BATIMENT'")
    four = F.col("geometry.geom_type") == "MultiPolygon"
    three = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    rings = F.when(four, F.try_element_at(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"), F.lit(1))).otherwise(three)
    p = F.transform(F.try_element_at(rings, F.lit(1)), lambda a: G.point(a[0], a[1], F.coalesce(F.get(a, F.lit(2)), F.lit(0.0))))
    return g.select("feature_id", p.alias("ring")).filter("ring is not null and size(ring) > 0")


RINGS = r"""WITH f AS (SELECT feature_id, CASE WHEN geometry.geom_type = 'MultiPolygon' THEN json_extract(geometry.coordinates::JSON, '$[0][0]') ELSE json_extract(geometry.coordinates::JSON, '$[0]') END AS r
  FROM geojson WHERE layer = 'BATIMENT' AND json_valid(geometry.coordinates)),
p AS (SELECT feature_id, unnest(range(len(l))) AS k, unnest(l) AS a FROM (SELECT feature_id, CAST(r AS DOUBLE[][]) AS l FROM f WHERE r IS NOT NULL)),
q AS (SELECT feature_id, k, a[1] AS x, a[2] AS y, coalesce(a[3], 0.0) AS z FROM p),
e AS (SELECT feature_id, max(k) AS last FROM q GROUP BY 1),
o AS (SELECT q.* FROM q JOIN e ON e.feature_id = q.feature_id JOIN q AS h ON h.feature_id = q.feature_id AND h.k = 0 JOIN q AS t ON t.feature_id = q.feature_id AND t.k = e.last
  WHERE NOT (q.k = e.last AND e.last > 0 AND h.x = t.x AND h.y = t.y AND h.z = t.z))"""


@query(
    RINGS
    + """, s AS (SELECT feature_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM o WINDOW w AS (PARTITION BY feature_id ORDER BY k))
  SELECT feature_id, count(*) AS n_points, round(sum((x - 2300000) * (ny - 6100000) - (nx - 2300000) * (y - 6100000)) / 2, 1) AS area FROM s GROUP BY 1"""
)
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rings(spark, sf_dir).select("feature_id", G.open_ring(F.col("ring")).alias("ring"))
    return r.select("feature_id", F.size("ring").cast("bigint").alias("n_points"), F.round(G.signed_area(F.col("ring")), 1).alias("area"))


@query(
    RINGS
    + """, s AS (SELECT feature_id, k, x, y, z, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM o WINDOW w AS (PARTITION BY feature_id ORDER BY k)),
  a AS (SELECT feature_id, sum((x - 2300000) * (ny - 6100000) - (nx - 2300000) * (y - 6100000)) AS area, count(*) AS n FROM s GROUP BY 1)
  SELECT s.feature_id, CASE WHEN a.area > 0 THEN a.n - 1 - k ELSE k END AS pos, x, y, z FROM s JOIN a ON a.feature_id = s.feature_id"""
)
def ring_clockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rings(spark, sf_dir).select("feature_id", G.clockwise(F.col("ring")).alias("ring"))
    return r.select("feature_id", F.posexplode("ring").alias("pos", "p")).select("feature_id", F.col("pos").cast("bigint").alias("pos"), "p.*")


@query(RINGS + " SELECT feature_id, x, y, z, min(k) AS first_pos FROM o GROUP BY ALL")
def ring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rings(spark, sf_dir).select("feature_id", G.open_ring(F.col("ring")).alias("all"))
    r = r.withColumn("ext", G.clean_rings(F.col("all"), F.array().cast("array<array<struct<x:double,y:double,z:double>>>"))[0])
    return r.select("feature_id", F.explode("ext").alias("p"), "all").select("feature_id", "p.*", (F.array_position("all", F.col("p")) - 1).alias("first_pos"))


def _prop(name: str):
    return F.get_json_object("properties", f"$.{name}")


@query("""SELECT feature_id, CAST(CASE WHEN TRY_CAST(properties ->> '$.HAUTEUR' AS DOUBLE) > 0 THEN TRY_CAST(properties ->> '$.HAUTEUR' AS DOUBLE) ELSE 10 END AS DOUBLE) AS height FROM geojson WHERE layer = 'BATIMENT'""")
def resolve_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "geojson").filter("layer = 'BATIMENT'")
    return g.select("feature_id", G.resolved("HAUTEUR", _prop, 10).alias("height"))


@query("""SELECT feature_id, CAST(CASE WHEN TRY_CAST(properties ->> '$.LARGEUR' AS DOUBLE) > 0 THEN TRY_CAST(properties ->> '$.LARGEUR' AS DOUBLE) ELSE 2 END AS DOUBLE) AS width FROM geojson WHERE layer = 'TRONCON_ROUTE'""")
def resolve_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "geojson").filter("layer = 'TRONCON_ROUTE'")
    return g.select("feature_id", G.resolved("LARGEUR", _prop, 2).alias("width"))


@query("""SELECT feature_id, CAST(coalesce(TRY_CAST(properties ->> '$.Z_MIN' AS DOUBLE), 0) AS DOUBLE) AS z FROM geojson WHERE layer = 'BATIMENT'""")
def resolve_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "geojson").filter("layer = 'BATIMENT'")
    return g.select("feature_id", G.resolved_z("Z_MIN", _prop, F.lit(None).cast("double")).alias("z"))


@query("""SELECT feature_id FROM geojson WHERE coalesce(TRY_CAST(properties ->> '$.PREC_ALTI' AS DOUBLE), 0) < 9999""")
def prec_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.precise(read(spark, sf_dir, "geojson"), "PREC_ALTI").select("feature_id")


@query(
    V.ctes("v_foot")
    + """, c AS (SELECT id, k, z, height, gx + CASE WHEN k IN (1, 2) THEN w ELSE 0 END AS x, gy + CASE WHEN k IN (2, 3) THEN d ELSE 0 END AS y FROM v_foot, (SELECT unnest(range(4)) AS k)),
  e AS (SELECT a.id, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.z, a.height FROM c a JOIN c b ON b.id = a.id AND b.k = (a.k + 1) % 4),
  t AS (SELECT id, k * 2 AS tri_no, [[x1, y1, z], [x2, y2, z], [x2, y2, z + height]] AS p FROM e UNION ALL SELECT id, k * 2 + 1, [[x1, y1, z], [x2, y2, z + height], [x1, y1, z + height]] FROM e)
  SELECT id, CAST(tri_no AS INTEGER) AS tri_no, CAST(j AS INTEGER) AS corner, p[j + 1][1] AS x, p[j + 1][2] AS y, round(p[j + 1][3], 6) AS z FROM t, (SELECT unnest(range(3)) AS j)"""
)
def extrude_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.footprints(spark, sf_dir).withColumn("tri", G.walls(F.col("ring"), F.col("height")))
    return rounded(V.flat(f, "id"))


# --- colors


@query(
    V.ctes("v_points")
    + " SELECT ord, CAST(round_even((x - (SELECT min(x) FROM v_points)) / ((SELECT max(x) FROM v_points) - (SELECT min(x) FROM v_points)) * 19, 0) + 1 AS INTEGER) AS material_index FROM v_points"
)
def color_ramp_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.view(spark, sf_dir, "v_points")
    ends = F.broadcast(p.agg(F.min("x").alias("low"), F.max("x").alias("high")))  # one row
    return p.crossJoin(ends).select("ord", G.ramp_index(F.col("x"), F.col("low"), F.col("high")).alias("material_index"))


@query(V.ctes("v_points") + ", f AS (SELECT klass, min(ord) AS first FROM v_points GROUP BY 1), i AS (SELECT klass, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS material_index FROM f) SELECT ord, material_index FROM v_points JOIN i USING (klass)")
def color_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.view(spark, sf_dir, "v_points")
    i = row_numbers(p.groupBy("klass").agg(F.min("ord").alias("first")), ["first"], "no").select("klass", (F.col("no") + 1).cast("int").alias("material_index"))
    return p.join(i, "klass").select("ord", "material_index")


@query("SELECT p_partkey AS id, round(p_partkey % 256 / 255, 4) AS r, round(p_size / 255, 4) AS g, round(p_partkey * 7 % 256 / 255, 4) AS b, CAST(1 AS DOUBLE) AS a FROM part")
def color_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("#"), two(F.col("p_partkey") % 256), two("p_size"), two(F.col("p_partkey") * 7 % 256)).alias("hex"))
    c = G.hex_color(F.col("hex"))
    return p.select("id", *[c[i].alias(n) for i, n in enumerate("rgba")])


# --- attributes


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("tile"), F.from_json("props", "map<string,string>").alias("props"))


@query("""WITH f AS (SELECT user_id AS tile, event_id, json_keys(props) AS k FROM events), ok AS (SELECT tile FROM f GROUP BY 1 HAVING bool_and(coalesce(len(k), 0) > 0))
  SELECT DISTINCT f.tile, unnest(k) AS key FROM f JOIN ok ON ok.tile = f.tile""")
def batch_table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.batch_table(_props(spark, sf_dir), "tile", "props", "ord").select("tile", "key")


@query("""WITH f AS (SELECT user_id AS tile, event_id, props ->> '$.k' AS v, json_keys(props) AS k FROM events), ok AS (SELECT tile FROM f GROUP BY 1 HAVING bool_and(coalesce(len(k), 0) > 0))
  SELECT f.tile, 'k' AS key, string_agg(coalesce(v, ''), ',' ORDER BY event_id) AS cells FROM f JOIN ok ON ok.tile = f.tile GROUP BY 1""")
def batch_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = grouping.batch_table(_props(spark, sf_dir), "tile", "props", "ord")
    return b.select("tile", "key", F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(""))), ",").alias("cells"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')")
def filter_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.keep_ids(read(spark, sf_dir, "part"), ["Brand#2", "Brand#17"], "p_brand").select(F.col("p_partkey").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand NOT IN ('Brand#2', 'Brand#17')")
def filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.keep_ids(read(spark, sf_dir, "part"), ["Brand#2", "Brand#17"], "p_brand", exclude=True).select(F.col("p_partkey").alias("id"))


# --- meshes and textures


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.footprints(spark, sf_dir).withColumn("tri", G.walls(F.col("ring"), F.col("height")))
    v = V.flat(f, "id")
    return rounded(v.withColumn("ord", (F.col("id") * 8 + F.col("tri_no")) * 3 + F.col("corner")))


MESH = SQL["extrude_walls"].rpartition("SELECT id, CAST(tri_no")[0] + ", m AS (SELECT (id * 8 + tri_no) * 3 + j AS ord, p[j + 1][1] AS x, p[j + 1][2] AS y, round(p[j + 1][3], 6) AS z FROM t, (SELECT unnest(range(3)) AS j)), i AS (SELECT x, y, z, row_number() OVER (ORDER BY min(ord)) AS vertex_no FROM m GROUP BY x, y, z)"


@query(MESH + " SELECT x, y, z, vertex_no FROM i")
def obj_vertex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.vertex_index(_mesh(spark, sf_dir)).withColumn("vertex_no", F.col("vertex_no").cast("bigint"))


@query(MESH + ", cc AS (SELECT CAST(floor(m.ord / 3) AS BIGINT) AS face, m.ord % 3 AS k, vertex_no FROM m JOIN i ON i.x = m.x AND i.y = m.y AND i.z = m.z) SELECT face, max(CASE k WHEN 0 THEN vertex_no END) AS a, max(CASE k WHEN 1 THEN vertex_no END) AS b, max(CASE k WHEN 2 THEN vertex_no END) AS c FROM cc GROUP BY face")
def obj_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored(_mesh(spark, sf_dir))
    # sizes are guessed without what is exploded, so neither side may be broadcast
    c = m.join(grouping.vertex_index(m).hint("merge"), ["x", "y", "z"]).select(F.floor(F.col("ord") / 3).alias("face"), (F.col("ord") % 3).alias("k"), F.col("vertex_no").cast("bigint").alias("no"))
    return c.groupBy("face").agg(*[F.max(F.when(F.col("k") == i, F.col("no"))).alias(n) for i, n in enumerate("abc")])


def _uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tri_no, corner, u, v): two of the soup's axes as texture coordinates, with each feature's bounds."""
    f = V.soup(spark, sf_dir).withColumn("uv", F.transform("tri", lambda t: F.struct(*[F.struct(t[k]["x"].alias("u"), t[k]["y"].alias("v")).alias(k) for k in "abc"])))
    f = f.withColumn("b", G.uv_bounds(F.col("uv")))
    return V.flat(f, "id", "b").select("id", "tri_no", "corner", "b", F.col("x").alias("u"), F.col("y").alias("v"))


UV = W_SOUP + ", b AS (SELECT id, min(x) AS u0, max(x) AS u1, min(y) AS v0, max(y) AS v1 FROM verts GROUP BY id), c AS (SELECT v.id, tri_no, corner, (x - u0) / CASE WHEN u1 > u0 THEN u1 - u0 ELSE 1 END AS u, (y - v0) / CASE WHEN v1 > v0 THEN v1 - v0 ELSE 1 END AS v, u1 - u0 AS du, v1 - v0 AS dv FROM verts v JOIN b ON b.id = v.id)"


@query(UV + " SELECT id, tri_no, corner, round(u, 6) AS u, round(v, 6) AS v FROM c")
def uv_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_uv(spark, sf_dir).select("id", "tri_no", "corner", G.uv_crop(F.col("u"), F.col("b.umin"), F.col("b.umax")).alias("u"), G.uv_crop(F.col("v"), F.col("b.vmin"), F.col("b.vmax")).alias("v")))


@query(UV + " SELECT id, tri_no, corner, round(u * 61 / 517 + (id % 8 * 61) / 517, 6) AS u, round(v * 37 / 259 + (id % 4 * 37) / 259, 6) AS v FROM c")
def uv_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _uv(spark, sf_dir)
    u, v = G.uv_crop(F.col("u"), F.col("b.umin"), F.col("b.umax")), G.uv_crop(F.col("v"), F.col("b.vmin"), F.col("b.vmax"))
    return rounded(c.select("id", "tri_no", "corner", G.uv_place(u, F.lit(61.0), F.col("id") % 8 * 61, F.lit(517.0)).alias("u"), G.uv_place(v, F.lit(37.0), F.col("id") % 4 * 37, F.lit(259.0)).alias("v")))


@query("SELECT p_brand AS tile, CAST(power(2, ceil(log2(sqrt(sum(p_size * (p_size + 3)))))) AS INTEGER) AS side FROM part GROUP BY 1")
def atlas_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tile")).agg(F.sum(F.col("p_size") * (F.col("p_size") + 3)).alias("area"))
    return a.select("tile", G.power_of_two(F.sqrt("area")).alias("side"))


@query("SELECT p_partkey AS id, CAST(power(2, ceil(log2(greatest(1, floor(p_size * 16 / 3))))) AS INTEGER) AS side FROM part")
def atlas_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.power_of_two(F.floor(F.col("p_size") * 16 / 3)).alias("side"))


