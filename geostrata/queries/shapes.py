"""Queries of shapes: twins say what SQL can of them (areas, counts); the tests hold them to invariants and brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.functions import mesh
from geostrata.operators import atlas, tiles
from geostrata.plans import pipelines as P
from geostrata.queries import tiles as T
from geostrata.queries import views as V
from geostrata.queries.tiles import rounded
from geostrata.runtime import read, stored
from geostrata.sources import files

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "geojson")
    raw = g.select(F.col("feature_id").alias("ord"), F.col("feature_id").cast("string").alias("id"), "properties", F.col("geometry.geom_type").alias("geom_type"), F.col("geometry.coordinates").alias("coordinates"))
    return P.geojson_features(raw, P.Options())


def _area(tri):
    """Area in the plane of the triangles that aren't walls."""
    return F.aggregate(F.transform(tri, lambda t: F.abs(G.cross(t)["z"]) / 2), F.lit(0.0), lambda a, b: a + b)


_LINES = r"""WITH raw AS (SELECT feature_id, properties, CASE WHEN geometry.geom_type = 'MultiLineString' THEN json_extract(geometry.coordinates::JSON, '$[0]') ELSE geometry.coordinates::JSON END AS r
  FROM geojson WHERE geometry.geom_type IN ('LineString', 'MultiLineString') AND json_valid(geometry.coordinates)),
pt0 AS (SELECT feature_id, properties, unnest(range(len(l))) AS k, unnest(l) AS a FROM (SELECT feature_id, properties, CAST(r AS DOUBLE[][]) AS l FROM raw WHERE r IS NOT NULL)),
pt1 AS (SELECT feature_id, CASE WHEN TRY_CAST(properties ->> '$.LARGEUR' AS DOUBLE) > 0 THEN TRY_CAST(properties ->> '$.LARGEUR' AS DOUBLE) ELSE 2 END AS w, k, a[1] AS x, a[2] AS y, lag(a) OVER (PARTITION BY feature_id ORDER BY k) AS b FROM pt0),
pt2 AS (SELECT feature_id, w, row_number() OVER (PARTITION BY feature_id ORDER BY k) AS k, x, y FROM pt1 WHERE b IS NULL OR b[1] <> x OR b[2] <> y),
seg AS (SELECT *, count(*) OVER p AS n, lead(x) OVER o - x AS dx, lead(y) OVER o - y AS dy FROM pt2 WINDOW p AS (PARTITION BY feature_id), o AS (PARTITION BY feature_id ORDER BY k)),
unit AS (SELECT *, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM seg WHERE n > 1),
sides AS (SELECT *, coalesce(lag(ux) OVER o, ux) AS px, coalesce(lag(uy) OVER o, uy) AS py, coalesce(ux, lag(ux) OVER o) AS qx, coalesce(uy, lag(uy) OVER o) AS qy FROM unit WINDOW o AS (PARTITION BY feature_id ORDER BY k)),
nrm AS (SELECT *, CASE WHEN size < 1e-12 THEN -py ELSE nx END AS mx, CASE WHEN size < 1e-12 THEN px ELSE ny END AS my, CASE WHEN size < 1e-12 THEN w / 2 ELSE w / size END AS s
  FROM (SELECT *, -(py + qy) AS nx, px + qx AS ny, power(py + qy, 2) + power(px + qx, 2) AS size FROM sides)),
ring AS (SELECT feature_id, n, k AS pos, x + mx * s AS x, y + my * s AS y FROM nrm UNION ALL SELECT feature_id, n, 2 * n + 1 - k, x - mx * s, y - my * s FROM nrm),
org AS (SELECT *, x - first_value(x) OVER o AS rx, y - first_value(y) OVER o AS ry FROM ring WINDOW o AS (PARTITION BY feature_id ORDER BY pos)),
nxt AS (SELECT *, coalesce(lead(rx) OVER o, 0) AS sx, coalesce(lead(ry) OVER o, 0) AS sy FROM org WINDOW o AS (PARTITION BY feature_id ORDER BY pos)),
buf AS (SELECT feature_id, CAST(2 * any_value(n) AS INTEGER) AS n_points, abs(sum(rx * sy - sx * ry)) / 2 AS area FROM nxt GROUP BY 1)"""


@query(
    _LINES
    + r""", poly AS (SELECT feature_id, unnest(range(len(rs))) AS i, unnest(rs) AS r FROM (SELECT feature_id, CAST(CASE WHEN geometry.geom_type = 'MultiPolygon' THEN json_extract(geometry.coordinates::JSON, '$[0]') ELSE geometry.coordinates::JSON END AS DOUBLE[][][]) AS rs
    FROM geojson WHERE geometry.geom_type IN ('Polygon', 'MultiPolygon') AND json_valid(geometry.coordinates)) WHERE len(rs) > 0),
  pp AS (SELECT feature_id, i, unnest(range(len(r))) AS k, unnest(r) AS a FROM poly),
  po AS (SELECT *, a[1] - first_value(a[1]) OVER o AS x, a[2] - first_value(a[2]) OVER o AS y FROM pp WINDOW o AS (PARTITION BY feature_id, i ORDER BY k)),
  pn AS (SELECT *, coalesce(lead(x) OVER o, 0) AS nx, coalesce(lead(y) OVER o, 0) AS ny FROM po WINDOW o AS (PARTITION BY feature_id, i ORDER BY k)),
  ra AS (SELECT feature_id, i, abs(sum(x * ny - nx * y)) / 2 AS area FROM pn GROUP BY 1, 2),
  bad AS (SELECT DISTINCT h.feature_id, h.i FROM pp h JOIN pp e ON e.feature_id = h.feature_id AND e.i = 0 AND h.i > 0 AND e.a = h.a),
  solid AS (SELECT feature_id, sum(CASE WHEN i = 0 THEN area ELSE -area END) AS area FROM ra WHERE (feature_id, i) NOT IN (SELECT (feature_id, i) FROM bad) GROUP BY 1),
  side AS (SELECT feature_id, k, x + mx * s AS lx, y + my * s AS ly, x - mx * s AS rx, y - my * s AS ry FROM nrm),
  quad AS (SELECT *, lead(lx) OVER o - lx AS ax, lead(ly) OVER o - ly AS ay, lead(rx) OVER o - lx AS bx, lead(ry) OVER o - ly AS by_, rx - lx AS cx, ry - ly AS cy FROM side WINDOW o AS (PARTITION BY feature_id ORDER BY k)),
  strip AS (SELECT feature_id, sum(abs(ax * by_ - ay * bx) + abs(bx * cy - by_ * cx)) / 2 AS area FROM quad GROUP BY 1),
  still AS (SELECT DISTINCT feature_id FROM pt1 WHERE b[1] = x AND b[2] = y),
  every AS (SELECT feature_id, area FROM solid UNION ALL SELECT r.feature_id, CASE WHEN s.feature_id IS NULL THEN coalesce(area, 0) ELSE 0 END FROM (SELECT DISTINCT feature_id FROM pt0) r LEFT JOIN strip ON strip.feature_id = r.feature_id LEFT JOIN still s ON s.feature_id = r.feature_id)
  SELECT e.feature_id, round(area, 2) + 0.0 AS roof_area FROM every e JOIN geojson g ON g.feature_id = e.feature_id WHERE coalesce(TRY_CAST(g.properties ->> '$.PREC_ALTI' AS DOUBLE), 0) < 9999"""
)
def geojson_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every footprint and road raised: the area of its roof. What a footprint's holes have outside of it counts against it, as it faces down."""
    upwards = F.aggregate(F.transform("tri", lambda t: G.cross(t)["z"] / 2), F.lit(0.0), lambda a, b: a + b)
    area = F.when(F.col("line"), _area(F.col("tri"))).otherwise(upwards)
    return rounded(_solids(spark, sf_dir).select(F.col("ord").alias("feature_id"), area.alias("roof_area")), 2)


@query(T.RINGS + """, s AS (SELECT feature_id, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM o WINDOW w AS (PARTITION BY feature_id ORDER BY k))
  SELECT feature_id, round(abs(sum((x - 2300000) * (ny - 6100000) - (nx - 2300000) * (y - 6100000))) / 2, 1) AS area FROM s GROUP BY 1""")
def triangulate_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ring of every building cut into triangles: their area together is the ring's."""
    r = stored(T._rings(spark, sf_dir).withColumn("holes", F.array().cast("array<array<struct<x:double,y:double,z:double>>>")))
    return r.select("feature_id", F.round(_area(mesh.triangulated("ring", "holes")), 1).alias("area"))


@query(V.ctes("v_foot") + " SELECT id, 10 AS n_tri, round(w * d, 3) AS roof_area FROM v_foot")
def hull_extrude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint hulls from the lowest point to the mean of the tops."""
    f = V.footprints(spark, sf_dir).withColumn("tri", G.walls(F.col("ring"), F.col("height"))).withColumn("tile", F.lit(0)).withColumn("ord", F.col("id"))
    out = tiles.lod1(stored(f))
    return rounded(out.select(F.col("ord").alias("id"), F.size("tri").alias("n_tri"), _area(F.col("tri")).alias("roof_area")), 3)


@query(_LINES + " SELECT b.feature_id, n_points, round(area, 2) AS area FROM buf b JOIN geojson g ON g.feature_id = b.feature_id WHERE layer = 'TRONCON_ROUTE'")
def line_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads as rings of their width: number of points and area."""
    g = read(spark, sf_dir, "geojson").filter("layer = 'TRONCON_ROUTE'")
    line = files.filled_points(F.get(files.rings(F.col("geometry.geom_type"), F.col("geometry.coordinates")), F.lit(0)))
    g = stored(g.select("feature_id", F.transform(line, lambda p: G.point(p["x"], p["y"], F.coalesce(p["z"], F.lit(0.0)))).alias("line"), G.resolved("LARGEUR", lambda k: F.get_json_object("properties", f"$.{k}"), 2).alias("w")).filter("line is not null"))
    r = stored(g.select("feature_id", mesh.buffered("line", "w").alias("ring"))).filter("size(ring) > 0")  # a line of one place has no ring
    near = F.transform("ring", lambda p: G.point(p["x"] - F.col("ring")[0]["x"], p["y"] - F.col("ring")[0]["y"], F.lit(0.0)))
    return r.select("feature_id", F.size("ring").alias("n_points"), F.round(F.abs(G.signed_area(near)), 2).alias("area"))


@query()
def atlas_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of pictures by brand."""
    p = read(spark, sf_dir, "part")
    tile = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return atlas.packed(p.select(tile.alias("tile"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), (F.col("p_size") + 3).alias("height")))


@query()
def tile_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GeoJSON features as B3DM content by tile: members, bounds around the center, translation and bytes."""
    f = tiles.partitioned(stored(_solids(spark, sf_dir)))
    c = tiles.contents(f, [])
    return rounded(c.select("tile", "n_features", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax", "tx", "ty", "tz", F.length("b3dm").alias("bytes")), 4)
