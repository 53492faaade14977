"""Queries of the city-model and lineage operators with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.operators import citydb, lineage
from geostrata.queries import views as V
from geostrata.queries.tiles import rounded
from geostrata.runtime import read, stored

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- objects


@query("SELECT b.id, c.gmlid FROM building b JOIN cityobject c ON c.id = b.id WHERE b.id = b.building_root_id")
def city_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citydb.objects(read(spark, sf_dir, "building"), read(spark, sf_dir, "cityobject"), "building_root_id")


def _of_class(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return read(spark, sf_dir, "cityobject").filter(F.col("objectclass_id") == k).select("id").distinct()


for _name, _class in (("city_reliefs", 14), ("city_waterbodies", 9), ("city_bridges", 64)):
    QUERIES[_name] = lambda spark, sf_dir, k=_class: citydb.objects(_of_class(spark, sf_dir, k), read(spark, sf_dir, "cityobject"))
    SQL[_name] = f"SELECT o.id, c.gmlid FROM (SELECT DISTINCT id FROM cityobject WHERE objectclass_id = {_class}) o JOIN cityobject c ON c.id = o.id"


@query("SELECT id, classname FROM objectclass")
def class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "objectclass").select("id", "classname")


# --- geometries

S = (
    V.ctes("v_surface", "v_building")
    + """, ts AS (SELECT *, CASE flag WHEN 'A' THEN 33 WHEN 'N' THEN 34 ELSE 35 END AS class_id FROM v_surface),
j AS (SELECT s.id + 1000000000 AS surface_id, b.building_root_id, bc.classname AS building_class, sc.classname AS surface_class, s.x0, s.y0, s.w, s.h
  FROM ts s JOIN v_building b ON b.id = s.building_id JOIN objectclass bc ON bc.id = b.objectclass_id LEFT JOIN objectclass sc ON sc.id = s.class_id)"""
)


def _size(df: DataFrame, *keys: str) -> DataFrame:
    """Number of triangles and bounds, which are what SQL can say of a geometry."""
    b = G.bbox(F.col("tri"))
    return df.select(*keys, F.size("tri").cast("bigint").alias("n_tri"), b.alias("b")).select(*keys, "n_tri", F.col("b.xmin").alias("xmin"), F.col("b.ymax").alias("ymax"), F.col("b.zmax").alias("zmax"))


@query(S + " SELECT building_root_id AS id, building_class AS classname, count(*) * 2 AS n_tri, min(x0) AS xmin, max(y0 + h) AS ymax, max(h) AS zmax FROM j GROUP BY 1, 2")
def city_geometry_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.merged(citydb.building_surfaces(V.surfaces(spark, sf_dir)), "building_root_id", "building_class"), "id", "classname")


@query(S + " SELECT surface_id AS id, surface_class AS classname, CAST(2 AS BIGINT) AS n_tri, x0 AS xmin, y0 + h AS ymax, h AS zmax FROM j")
def city_geometry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.split(citydb.building_surfaces(V.surfaces(spark, sf_dir)), "surface_class"), "id", "classname")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Terrain, water and bridges of suppliers and customers over the same surfaces."""
    t = V.surfaces(spark, sf_dir)
    s = V.view(spark, sf_dir, "v_surface")
    root = F.col("id").alias("lod3_surface_id")
    feature = F.floor(F.col("y0")).cast("bigint")
    t["tin_relief"] = s.select((F.col("id") + 1).alias("id"), F.col("id").alias("surface_geometry_id"))
    t["relief_feat_to_rel_comp"] = s.select(feature.alias("relief_feature_id"), (F.col("id") + 1).alias("relief_component_id"))
    t["relief_feature"] = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(14).alias("objectclass_id"))
    t["waterboundary_surface"] = s.select((F.col("id") + 2).alias("id"), root, F.lit(36).alias("objectclass_id"))
    t["waterbod_to_waterbnd_srf"] = s.select(feature.alias("waterbody_id"), (F.col("id") + 2).alias("waterboundary_surface_id"))
    t["waterbody"] = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(9).alias("objectclass_id"))
    t["bridge"] = s.select("id", F.col("building_id").alias("bridge_root_id"), F.col("id").alias("lod2_multi_surface_id"), F.lit(64).alias("objectclass_id"))
    t["surface_data"] = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("tex_image_id"))
    t["tex_image"] = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("img_"), "r_name").alias("tex_image_uri"), F.encode("r_name", "utf-8").alias("tex_image_data"))
    uv = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    one = F.struct(uv(F.lit(0.0), F.lit(0.0)).alias("a"), uv(F.col("w") / 50, F.lit(0.0)).alias("b"), uv(F.col("w") / 50, F.col("h") / 10).alias("c"))
    t["textureparam"] = s.select((F.col("id") + 1_000_000_000).alias("surface_geometry_id"), (F.col("building_id") % 25).alias("surface_data_id"), F.array(one, one).alias("uv"))
    return t


RELIEF = S + ", k AS (SELECT s.*, u.s_suppkey AS fid FROM v_surface s JOIN supplier u ON u.s_suppkey = CAST(s.y0 AS BIGINT))"


@query(RELIEF + " SELECT fid AS id, 'ReliefFeature' AS classname, count(*) * 2 AS n_tri, min(x0) AS xmin, max(y0 + h) AS ymax, max(h) AS zmax FROM k GROUP BY 1")
def relief_geometry_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.merged(citydb.relief_surfaces(_tables(spark, sf_dir)), "relief_feature_id", "classname"), "id", "classname")


@query(RELIEF + " SELECT id + 1000000000 AS id, 'ReliefFeature' AS classname, CAST(2 AS BIGINT) AS n_tri, x0 AS xmin, y0 + h AS ymax, h AS zmax FROM k")
def relief_geometry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.split(citydb.relief_surfaces(_tables(spark, sf_dir)), "classname"), "id", "classname")


@query(S + " SELECT id + 1000000000 AS id, 'Bridge' AS classname, CAST(2 AS BIGINT) AS n_tri, x0 AS xmin, y0 + h AS ymax, h AS zmax FROM v_surface")
def bridge_geometry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.split(citydb.bridge_surfaces(_tables(spark, sf_dir)), "classname"), "id", "classname")


@query(RELIEF + " SELECT fid AS id, 'WaterBody' AS classname, count(*) * 2 AS n_tri, min(x0) AS xmin, max(y0 + h) AS ymax, max(h) AS zmax FROM k GROUP BY 1")
def water_geometry_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.merged(citydb.water_surfaces(_tables(spark, sf_dir)), "waterbody_id", "body_class"), "id", "classname")


@query(RELIEF + " SELECT id + 1000000000 AS id, 'ClosureSurface' AS classname, CAST(2 AS BIGINT) AS n_tri, x0 AS xmin, y0 + h AS ymax, h AS zmax FROM k")
def water_geometry_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.split(citydb.water_surfaces(_tables(spark, sf_dir)), "surface_class"), "id", "classname")


@query(S + " SELECT building_id AS id, 'Bridge' AS classname, count(*) * 2 AS n_tri, min(x0) AS xmin, max(y0 + h) AS ymax, max(h) AS zmax FROM v_surface GROUP BY 1")
def bridge_geometry_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(citydb.merged(citydb.bridge_surfaces(_tables(spark, sf_dir)), "bridge_root_id", "classname"), "id", "classname")


_UV = """, u AS (SELECT id + 1000000000 AS surface_id, building_id % 25 AS data_id, w / 50 AS u1, h / 10 AS v1 FROM v_surface),
uv AS (SELECT surface_id, concat('img_', r_name) AS tex_image_uri, tri_no, corner, round(CASE WHEN corner = 0 THEN 0.0 ELSE u1 END, 6) AS u, round(CASE WHEN corner = 2 THEN 1 - v1 ELSE 1.0 END, 6) AS v
  FROM u JOIN nation ON n_nationkey = data_id JOIN region ON r_regionkey = n_regionkey, (SELECT unnest(range(2)) AS tri_no), (SELECT unnest(range(3)) AS corner))"""
_UV_OUT = "uv.surface_id, tex_image_uri, CAST(tri_no AS INTEGER) AS tri_no, CAST(corner AS INTEGER) AS corner, u, v FROM uv"


def _corners(x: DataFrame) -> DataFrame:
    """Every corner's texture coordinates."""
    t = x.select("surface_id", "tex_image_uri", F.posexplode("uv").alias("tri_no", "t")).select("surface_id", "tex_image_uri", "tri_no", F.posexplode(F.array("t.a", "t.b", "t.c")).alias("corner", "p"))
    return rounded(t.select("surface_id", "tex_image_uri", "tri_no", "corner", "p.u", "p.v"))


def _textured(surfaces, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _tables(spark, sf_dir)
        return _corners(citydb.textured(surfaces(t), t["textureparam"], t["surface_data"], t["tex_image"]))

    return run, sql


for _name, _surfaces, _text in (
    ("city_textured", citydb.building_surfaces, S + _UV + f" SELECT {_UV_OUT} JOIN j ON j.surface_id = uv.surface_id"),
    ("relief_textured", citydb.relief_surfaces, RELIEF + _UV + f" SELECT {_UV_OUT} JOIN k ON k.id + 1000000000 = uv.surface_id"),
    ("water_textured", citydb.water_surfaces, RELIEF + _UV + f" SELECT {_UV_OUT} JOIN k ON k.id + 1000000000 = uv.surface_id"),
    ("bridge_textured", citydb.bridge_surfaces, S + _UV + f" SELECT {_UV_OUT}"),
):
    QUERIES[_name], SQL[_name] = _textured(_surfaces, _text)


@query("SELECT DISTINCT concat('img_', r_name) AS tex_image_uri, CAST(length(r_name) AS INTEGER) AS n_bytes FROM region JOIN nation ON n_regionkey = r_regionkey")
def texture_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    wanted = t["surface_data"].join(t["tex_image"].select(F.col("id").alias("tex_image_id"), "tex_image_uri"), "tex_image_id")
    return citydb.texture_images(wanted, t["tex_image"]).select("tex_image_uri", F.length("tex_image_data").alias("n_bytes"))


@query(
    S
    + """, t AS (SELECT building_root_id AS id, x0 + w * 2 / 3 AS x, y0 + h / 3 AS y, h AS z, w * h / 2 AS a FROM j UNION ALL SELECT building_root_id, x0 + w / 3, y0 + h * 2 / 3, h, w * h / 2 FROM j),
  m AS (SELECT id, sum(x * a) / sum(a) AS cx, sum(y * a) / sum(a) AS cy FROM t GROUP BY id),
  n AS (SELECT m.id, cx, cy, j.h AS z, round(sqrt(power(greatest(x0 - cx, 0, cx - x0 - w), 2) + power(greatest(y0 - cy, 0, cy - y0 - j.h), 2)), 6) AS far FROM m JOIN j ON j.building_root_id = m.id)
  SELECT id, round(any_value(cx), 3) AS x, round(any_value(cy), 3) AS y, min(z) AS z FROM (SELECT *, min(far) OVER (PARTITION BY id) AS least FROM n) WHERE far = least GROUP BY id"""
)
def city_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citydb.centroids(citydb.building_surfaces(V.surfaces(spark, sf_dir)), "building_root_id")
    return rounded(c.select("id", "x", "y", "z"), 3)


@query(S + ", c AS (SELECT building_class, surface_class, min(surface_id) AS first FROM j GROUP BY 1, 2), f AS (SELECT surface_class, min(first) AS first FROM c GROUP BY 1) SELECT surface_class AS classname, CAST(row_number() OVER (ORDER BY first, surface_class) AS INTEGER) AS material_index FROM f WHERE surface_class IS NOT NULL")
def city_class_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A material for each class of surfaces, by first use."""
    return citydb.class_materials(citydb.building_surfaces(V.surfaces(spark, sf_dir)), "surface_class", "surface_id")


# --- hierarchies

B = S + """, p AS (SELECT 0 AS kind, s.id + 2000000000 AS id, s.building_id AS parent_id, concat('SRF_', s.id) AS gmlid, s.class_id AS objectclass_id FROM ts s JOIN v_building b ON b.id = s.building_id
  UNION ALL SELECT 1, id, building_parent_id, gmlid, objectclass_id FROM v_building),
i AS (SELECT CAST(row_number() OVER (ORDER BY kind, p.id) - 1 AS INTEGER) AS position, p.id, parent_id, gmlid, o.classname FROM p LEFT JOIN objectclass o ON o.id = p.objectclass_id)"""


def _hierarchy_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = V.surfaces(spark, sf_dir)
    return t | {"thematic_surface": t["thematic_surface"].withColumn("id", F.col("id") + 2_000_000_000)}


@query(B + " SELECT id, parent_id, gmlid, objectclass_id FROM p WHERE kind = 0")
def bth_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citydb.hierarchy_surfaces(_hierarchy_tables(spark, sf_dir))


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _hierarchy_tables(spark, sf_dir)
    return citydb.hierarchy_instances(t["building"], t["cityobject"], citydb.hierarchy_surfaces(t), t["objectclass"]).withColumn("position", F.col("position").cast("int"))


@query(B + " SELECT * FROM i")
def bth_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces, then buildings and parts, with their positions."""
    return _instances(spark, sf_dir)


@query(B + " SELECT a.position, p.position AS parent_position FROM i a JOIN i p ON p.id = a.parent_id")
def bth_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citydb.hierarchy_parents(stored(_instances(spark, sf_dir)))


@query("SELECT DISTINCT c.id, c.gmlid, b.building_root_id FROM building b JOIN cityobject c ON c.id = b.id WHERE c.gmlid IS NOT NULL")
def objects_reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query found for buildings, matched back to the objects by gmlid."""
    c = read(spark, sf_dir, "cityobject")
    b = read(spark, sf_dir, "building").select("id", "building_root_id")
    found = b.join(c.select("id", "gmlid"), "id").select("gmlid", "building_root_id", F.col("id").alias("own"))
    return citydb.reattach(c.select("id", "gmlid").distinct(), found.distinct()).filter("id = own").select("id", "gmlid", "building_root_id")


# --- lineage

GRAPH = V.ctes("v_ids") + ", e AS (SELECT src, dst, min(struct_pack(edge_id := edge_id, tag := tag)) AS x FROM v_edges GROUP BY 1, 2), ed AS (SELECT x.edge_id AS edge_id, src, dst, x.tag AS tag FROM e), v AS (SELECT globalid, CAST(split_part(globalid, '::', 1) AS INTEGER) AS ts FROM v_ids)"
DEG = GRAPH + ", o AS (SELECT src, count(*) AS n_out FROM ed GROUP BY 1), i AS (SELECT dst, count(*) AS n_in FROM ed GROUP BY 1)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = lineage.vertices_of(V.view(spark, sf_dir, "v_ids"))
    e = V.view(spark, sf_dir, "v_edges").select("edge_id", "src", "dst", "type", F.array("tag").alias("tags"))
    return v, e


def _split(spark: SparkSession, sf_dir: str):
    """The graph as two overlapping ones, to be united again."""
    v, e = graph(spark, sf_dir)
    mid = 1996
    return [v.filter(F.col("ts") <= mid), v.filter(F.col("ts") >= mid)], [e.filter(F.substring("src", 1, 4).cast("int") < mid), e.filter(F.substring("src", 1, 4).cast("int") >= mid)]


@query(GRAPH + " SELECT globalid, ts FROM v")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.union(*_split(spark, sf_dir))[0].select("globalid", "ts")


@query(GRAPH + " SELECT 'vertex' AS kind, globalid || ' from ' || ts || ' to ' || ts AS line FROM v UNION ALL SELECT 'edge', src || ' -> ' || dst || ' replace ' || tag FROM ed")
def graph_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return lineage.listing(v, lineage.distinct_edges(e))


@query(GRAPH + " SELECT globalid, ts FROM v WHERE globalid IN (SELECT dst FROM ed WHERE tag = 'modified')")
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices looked up by global id; ids are unique."""
    v, e = graph(spark, sf_dir)
    return lineage.lookup(v, e.filter(F.array_contains("tags", "modified")).select(F.col("dst").alias("globalid"))).select("globalid", "ts")


@query(GRAPH + " SELECT edge_id, src, dst, tag FROM ed")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.distinct_edges(graph(spark, sf_dir)[1]).select("edge_id", "src", "dst", F.col("tags")[0].alias("tag"))


@query(
    DEG
    + """ SELECT globalid, CASE WHEN n_in IS NULL AND n_out IS NULL THEN 'hapax' WHEN n_in IS NULL THEN 'start' WHEN n_out IS NULL THEN 'end' ELSE 'link' END AS status
  FROM v LEFT JOIN o ON o.src = globalid LEFT JOIN i ON i.dst = globalid"""
)
def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return lineage.degrees(v, lineage.distinct_edges(e)).select("globalid", "status")


@query(
    DEG
    + """, d AS (SELECT ed.*, n_out = 1 AND n_in = 1 AS one FROM ed JOIN o ON o.src = ed.src JOIN i ON i.dst = ed.dst)
  SELECT count(*) AS n_edges, count(*) FILTER (one) AS n_one_to_one, """
    + ", ".join(f"count(*) FILTER (tag = '{t}') AS n_{t}" for t in ("unchanged", "re_ided", "modified", "fused", "subdivided"))
    + ", "
    + ", ".join(f"count(*) FILTER (one AND tag = '{t}') AS n_{t}_one" for t in ("unchanged", "re_ided", "modified"))
    + " FROM d"
)
def edge_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edge_counts(lineage.distinct_edges(graph(spark, sf_dir)[1]))


CONTRACT = (
    DEG
    + """, c AS (SELECT ed.src, ed.dst FROM ed JOIN o ON o.src = ed.src JOIN i ON i.dst = ed.dst WHERE n_out = 1 AND n_in = 1 AND tag IN ('unchanged', 're_ided')),
w AS (SELECT src AS old, dst AS new FROM c UNION ALL SELECT w.old, c.dst FROM w JOIN c ON c.src = w.new),
j AS (SELECT old, new FROM w WHERE new NOT IN (SELECT src FROM c)),
cv AS (SELECT v.globalid, v.ts, least(v.ts, coalesce((SELECT min(a.ts) FROM j JOIN v a ON a.globalid = j.old WHERE j.new = v.globalid), v.ts)) AS start_date, v.ts AS end_date FROM v WHERE v.globalid NOT IN (SELECT old FROM j))"""
)


@query(CONTRACT + " SELECT globalid, start_date, end_date FROM cv")
def contract_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return lineage.contract(v, lineage.distinct_edges(e))[0].select("globalid", "start_date", "end_date")


#: The years that orders of the test tables may have.
YEARS = range(1990, 2004)


def _collapses() -> str:
    """The collapses as a chain of common table expressions, a few for each of YEARS: fN and gN are the graph after N years' fusions, vN and wN after N years' subdivisions."""
    # read several times: worked out once
    out = CONTRACT.replace(" c AS (", " c AS MATERIALIZED (").replace("j AS (SELECT old", "j AS MATERIALIZED (SELECT old").replace("ed AS (", "ed AS MATERIALIZED (").replace("cv AS (", "cv AS MATERIALIZED (") + """,
ke AS (SELECT ed.edge_id, coalesce(a.new, ed.src) AS src, coalesce(b.new, ed.dst) AS dst, ed.tag FROM ed LEFT JOIN c ON c.src = ed.src AND c.dst = ed.dst LEFT JOIN j a ON a.old = ed.src LEFT JOIN j b ON b.old = ed.dst WHERE c.src IS NULL),
f0 AS MATERIALIZED (SELECT * FROM cv), g0 AS MATERIALIZED (SELECT min(struct_pack(edge_id := edge_id, tag := tag)).tag AS tag, min(edge_id) AS edge_id, src, dst FROM ke GROUP BY src, dst)"""
    years = list(enumerate(YEARS))
    for k, year in years:
        out += f""",
fh{k} AS MATERIALIZED (SELECT e.dst, min(a.start_date) AS s0 FROM g{k} e JOIN f{k} d ON d.globalid = e.dst AND d.ts = {year} JOIN f{k} a ON a.globalid = e.src GROUP BY e.dst
  HAVING count(*) >= 2 AND bool_and(tag = 'fused') AND min(a.start_date) = max(a.start_date) AND min(a.end_date) = max(a.end_date)),
fx{k} AS MATERIALIZED (SELECT DISTINCT e.src AS globalid FROM g{k} e JOIN fh{k} h ON h.dst = e.dst),
f{k + 1} AS MATERIALIZED (SELECT v.globalid, v.ts, coalesce(h.s0, v.start_date) AS start_date, v.end_date FROM f{k} v LEFT JOIN fh{k} h ON h.dst = v.globalid WHERE v.globalid NOT IN (SELECT globalid FROM fx{k})),
g{k + 1} AS MATERIALIZED (SELECT * FROM g{k} WHERE src NOT IN (SELECT globalid FROM fx{k}) AND dst NOT IN (SELECT globalid FROM fx{k}))"""
    n = len(years)
    out += f", v0 AS MATERIALIZED (SELECT * FROM f{n}), w0 AS MATERIALIZED (SELECT * FROM g{n})"
    for k, year in years:
        out += f""",
sp{k} AS (SELECT e.src, v.start_date AS own FROM w{k} e JOIN v{k} v ON v.globalid = e.src AND v.ts = {year} JOIN v{k} d ON d.globalid = e.dst GROUP BY 1, 2
  HAVING count(*) >= 2 AND bool_and(tag = 'subdivided') AND min(d.start_date) = max(d.start_date) AND min(d.end_date) = max(d.end_date)),
up{k} AS (SELECT dst, count(*) AS n, min(src) AS ancestor, bool_and(tag = 'modified') AS modified FROM w{k} GROUP BY 1),
sx{k} AS MATERIALIZED (SELECT s.src, own, ancestor FROM sp{k} s LEFT JOIN up{k} u ON u.dst = s.src WHERE n IS NULL OR n = 1 AND modified),
hd{k} AS (SELECT e.dst, min(own) AS own FROM w{k} e JOIN sx{k} x ON x.src = e.src GROUP BY 1),
v{k + 1} AS MATERIALIZED (SELECT v.globalid, v.ts, coalesce(h.own, v.start_date) AS start_date, v.end_date FROM v{k} v LEFT JOIN hd{k} h ON h.dst = v.globalid WHERE v.globalid NOT IN (SELECT src FROM sx{k})),
w{k + 1} AS MATERIALIZED (SELECT min(struct_pack(edge_id := edge_id, tag := tag)).tag AS tag, min(edge_id) AS edge_id, src, dst FROM (
  SELECT tag, edge_id, src, dst FROM w{k} WHERE src NOT IN (SELECT src FROM sx{k}) AND dst NOT IN (SELECT src FROM sx{k})
  UNION ALL SELECT 'modified', edge_id, x.ancestor, e.dst FROM w{k} e JOIN sx{k} x ON x.src = e.src WHERE x.ancestor IS NOT NULL) GROUP BY src, dst)"""
    return out


COLLAPSES = _collapses()


@query(COLLAPSES + f" SELECT globalid, start_date, end_date FROM f{len(YEARS)}")
def fusion_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return lineage.collapse_fusions(*lineage.contract(v, lineage.distinct_edges(e)))[0].select("globalid", "start_date", "end_date")


@query(COLLAPSES + f" SELECT globalid, start_date, end_date FROM v{len(YEARS)}")
def subdivision_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.simplify(*graph(spark, sf_dir))[0].select("globalid", "start_date", "end_date")


@query(COLLAPSES + f" SELECT src, dst, tag AS tags FROM w{len(YEARS)}")
def simplified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.simplify(*graph(spark, sf_dir))[1].select("src", "dst", F.array_join(F.array_sort("tags"), ",").alias("tags"))


def _tx(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, e = graph(spark, sf_dir)
        t = lineage.transactions(v, lineage.distinct_edges(e)).filter(F.col("kind") == kind)
        return t.select("start_date", "end_date", F.array_join("source", ",").alias("source"), F.array_join("destination", ",").alias("destination"), F.col("aggregate"))

    return run


REQ = (
    DEG
    + """, q AS (SELECT ed.src, ed.dst, tag,
  tag = 'fused' OR (n_in >= 2 AND bool_and(tag = 'modified') OVER (PARTITION BY ed.dst)) AS fused, tag = 'subdivided' OR (n_out >= 2 AND bool_and(tag = 'modified') OVER (PARTITION BY ed.src)) AS parts,
  CAST(split_part(ed.src, '::', 1) AS INTEGER) AS a, CAST(split_part(ed.dst, '::', 1) AS INTEGER) AS b, n_out, n_in FROM ed JOIN o ON o.src = ed.src JOIN i ON i.dst = ed.dst)"""
)
for _kind, _text in (
    ("modification", "SELECT a AS start_date, b AS end_date, src AS source, dst AS destination, false AS aggregate FROM q WHERE tag = 'modified' AND n_out = 1 AND n_in = 1"),
    ("union", "SELECT min(a) AS start_date, max(b) AS end_date, string_agg(src, ',' ORDER BY src) AS source, dst AS destination, bool_or(tag = 'modified') AS aggregate FROM q GROUP BY dst HAVING count(*) >= 2 AND bool_and(fused)"),
    ("division", "SELECT min(a) AS start_date, max(b) AS end_date, src AS source, string_agg(dst, ',' ORDER BY dst) AS destination, bool_or(tag = 'modified') AS aggregate FROM q GROUP BY src HAVING count(*) >= 2 AND bool_and(parts)"),
):
    QUERIES[f"tx_{_kind}"], SQL[f"tx_{_kind}"] = _tx(_kind), f"{REQ} {_text}"


@query(GRAPH + " SELECT CAST(split_part(globalid, '::', 2) AS BIGINT) % 16 AS tile, min(ts) AS start_date, max(ts) AS end_date FROM v GROUP BY 1")
def temporal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = graph(spark, sf_dir)
    return lineage.bounds(v.withColumn("tile", F.col("local_id").cast("bigint") % 16), "tile")


@query(CONTRACT + " SELECT globalid FROM cv WHERE start_date <= 1997 AND end_date >= 1997")
def as_of_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = graph(spark, sf_dir)
    return lineage.alive(lineage.contract(v, lineage.distinct_edges(e))[0], 1997).select("globalid")


@query(GRAPH + " SELECT DISTINCT ts FROM v")
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = graph(spark, sf_dir)
    return spark.createDataFrame([(t,) for t in lineage.stamps(v)], "ts int")


@query(GRAPH + " SELECT v.globalid, o.o_orderkey AS id FROM v JOIN orders o ON o.o_custkey = CAST(split_part(v.globalid, '::', 2) AS BIGINT) AND year(o.o_orderdate) = v.ts")
def vertex_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("gmlid"), F.col("o_orderkey").alias("id"))
    return lineage.joined_buildings(graph(spark, sf_dir)[0], o).select("globalid", "id")


