"""The pN_ queries of the general operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.operators import fill, hierarchy, near, nested, wide_table
from geostrata.runtime import read, stored

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells of the wide table."""
    return wide_table.filled_cells(*wide_table.widen(read(spark, sf_dir, "ifc_property"), read(spark, sf_dir, "ifc_attribute")))


@query
def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table itself, one row per object; reals as doubles."""
    wide, _ = wide_table.widen(read(spark, sf_dir, "ifc_property"), read(spark, sf_dir, "ifc_attribute"))
    return wide.select("guid", *[F.col(c).cast("double") if t.startswith("decimal") else F.col(c) for c, t in wide.dtypes if c not in ("guid", "entity_ordinal")])


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, boxes, property sets and properties with the link to their parent."""
    t = nested.tiles_and_boxes(nested.tile_columns(read(spark, sf_dir, "tileset"), nested.BOXED))
    p = nested.sets_and_props(nested.property_columns(read(spark, sf_dir, "ifcobjectgeom"), nested.SETS))
    return t.unionByName(p).distinct()


@query
def p4_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile with depth, geometric error, refinement and content."""
    return nested.tiles(nested.tile_columns(read(spark, sf_dir, "tileset"))).withColumn("geometric_error", F.col("geometric_error").try_cast("double"))


@query
def p4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Center and half axes of every box of 12 numbers."""
    b = nested.boxes(nested.tile_columns(read(spark, sf_dir, "tileset")))
    return b.select("record_id", "node_path", *[F.col("box")[i].alias(n) for i, n in enumerate(["cx", "cy", "cz", "ux", "uy", "uz", "vx", "vy", "vz", "wx", "wy", "wz"])])


@query
def p4_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property with name, value and the value's kind."""
    return nested.prop_values(nested.property_columns(read(spark, sf_dir, "ifcobjectgeom")))


@query
def p4_psets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property set with its name."""
    return nested.psets(nested.property_columns(read(spark, sf_dir, "ifcobjectgeom"))).drop("parent_path")


def _building_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hierarchy.buildings(read(spark, sf_dir, "building"))
    r = hierarchy.resolve(b, "root").join(b.select("id", "root"), "id")
    wrong = F.when(F.col("root").isNull() | (F.col("root") != F.col("top_id")), F.lit("wrong_root"))
    return r.withColumn("fault", F.coalesce("fault", wrong))


def _tileset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "tileset")
    return hierarchy.tileset_links(t, nested.contents(nested.tile_columns(t, nested.NAMING)))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed chains, nodes below them, orphans and wrong stored roots."""
    b = _building_faults(spark, sf_dir).filter("fault is not null")
    t = hierarchy.resolve(_tileset_links(spark, sf_dir)).filter("fault in ('cycle', 'below_cycle')")
    one = lambda df, hier: df.select(F.lit(hier).alias("hier"), F.col("id").alias("node_id"), "fault", "top_id", F.col("links_up").cast("int").alias("links_up"))
    return one(b, "building").union(one(t, "tileset"))


@query
def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and top of every building row."""
    r = hierarchy.resolve(hierarchy.buildings(read(spark, sf_dir, "building")), "root", paths=True)
    return r.filter("fault is null or fault = 'orphan'").select("id", "top_id", F.col("links_up").cast("int").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query
def p3_merged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by many small partition forests that are merged level by level."""
    b = hierarchy.buildings(read(spark, sf_dir, "building"))
    r = hierarchy.resolve(b, "root", paths=True, task_rows=max(50, b.count() // 20))
    return r.filter("fault is null or fault = 'orphan'").select("id", "top_id", F.col("links_up").cast("int").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query
def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with every ancestor, itself included, of the trees that end."""
    r = hierarchy.resolve(hierarchy.buildings(read(spark, sf_dir, "building")), "root", paths=True)
    return hierarchy.closure(r.filter("fault is null or fault = 'orphan'"))


@query
def p3_tileset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and top of every tileset."""
    r = hierarchy.resolve(_tileset_links(spark, sf_dir), paths=True)
    return r.filter("fault is null or fault = 'orphan'").select("id", "top_id", F.col("links_up").cast("int").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose height or width was missing and is marked as filled."""
    f = fill.fill(read(spark, sf_dir, "geojson"))
    return f.filter("field_name in ('HAUTEUR', 'LARGEUR') and method <> 'observed'").select("feature_id", "field_name")


@query
def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled value with method and distance."""
    f = fill.fill(read(spark, sf_dir, "geojson"))
    return f.filter("method <> 'observed'").select("feature_id", "field_name", "num", "cat", "method", "gap_days")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features less than 5 m apart, and the zones around each feature."""
    p = stored(near.locations(read(spark, sf_dir, "geojson")))
    pairs = near.near_pairs(p, 5.0).select(F.lit("near").alias("rel"), "low_id", "high_id")
    zones = near.containing_zones(p, read(spark, sf_dir, "loa_zone"))
    return pairs.union(zones.select(F.lit("zone").alias("rel"), F.col("zone_id").alias("low_id"), F.col("feature_id").alias("high_id")))


@query
def p5_zones_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones around each feature, the way that more edges than fit a broadcast take: by strip and cell, crowded cells split."""
    p = stored(near.locations(read(spark, sf_dir, "geojson")))
    return near.containing_zones(p, read(spark, sf_dir, "loa_zone"), broadcast_rows=0, key_rows=100)


@query
def p5_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location of each feature in metres."""
    p = near.locations(read(spark, sf_dir, "geojson"))
    return p.select("feature_id", F.round(F.col("x") / near.UNIT, 4).alias("x"), F.round(F.col("y") / near.UNIT, 4).alias("y"))


SQL["p1_found"] = r"""
WITH names AS (
  SELECT attr_name, coalesce(data_kind, 'text') AS kind, lower(regexp_replace(coalesce(base_unit, ''), '[/().]', '', 'g')) AS unit,
         regexp_replace(lower(unnest(list_append(coalesce(alt_names, []), attr_name))), '[^\p{L}\p{N}]', '', 'g') AS key
  FROM ifc_attribute),
raw AS (
  SELECT p.guid, n.attr_name, n.kind, n.unit, p.exported_at, p.loaded_at, p.row_no,
         trim(regexp_replace(trim(regexp_replace(trim(p.prop_value), '^IFC[A-Z0-9]*\((.*)\)$', '\1')), '^(''(.*)''|"(.*)")$', '\2\3')) AS v
  FROM ifc_property p JOIN names n ON regexp_replace(lower(p.prop_name), '[^\p{L}\p{N}]', '', 'g') = n.key
  WHERE p.guid IS NOT NULL),
held AS (SELECT * FROM raw WHERE v IS NOT NULL AND lower(v) NOT IN ('', 'n/a', 'nan', 'null', 'none', '*', '$', '-', '--', 'unset', '?', '??')),
parts AS (
  SELECT *, replace(regexp_replace(regexp_extract(v, '^([+-]?[0-9][0-9 ]*(?:[.,][0-9]*)?(?:[eE][+-]?[0-9]+)?) *([^0-9 .,+-].*)?$', 1), '[ +]', '', 'g'), ',', '.') AS num,
         lower(replace(replace(regexp_replace(regexp_extract(v, '^([+-]?[0-9][0-9 ]*(?:[.,][0-9]*)?(?:[eE][+-]?[0-9]+)?) *([^0-9 .,+-].*)?$', 2), '[ /().]', '', 'g'), '²', '2'), '³', '3')) AS suffix
  FROM held),
scaled AS (
  SELECT *, CASE WHEN suffix = '' OR suffix = unit THEN 1.0
                 WHEN unit = 'm' THEN CASE suffix WHEN 'mm' THEN 0.001 WHEN 'cm' THEN 0.01 WHEN 'dm' THEN 0.1 END
                 WHEN unit = 'm2' THEN CASE suffix WHEN 'sqm' THEN 1.0 END
                 WHEN unit = 'm3' THEN CASE suffix WHEN 'l' THEN 0.001 END
                 WHEN unit = 'kg' THEN CASE suffix WHEN 'g' THEN 0.001 WHEN 't' THEN 1000.0 END END AS factor
  FROM parts),
typed AS (
  SELECT *, CASE
    WHEN kind = 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', '.t.', 'yes', 'ja', 'oui', '1') THEN 'true'
                                    WHEN lower(v) IN ('false', 'f', '.f.', 'no', 'nein', 'non', '0') THEN 'false' END
    WHEN kind = 'integer' THEN CASE WHEN suffix = '' AND TRY_CAST(num AS DOUBLE) = floor(TRY_CAST(num AS DOUBLE)) THEN CAST(TRY_CAST(num AS DOUBLE) AS BIGINT)::VARCHAR END
    WHEN kind = 'real' THEN CASE WHEN factor IS NOT NULL THEN CAST(CAST(round(TRY_CAST(num AS DOUBLE) * factor, 3) AS DECIMAL(20, 3)) AS VARCHAR) END
    ELSE v END AS cell_text
  FROM scaled)
SELECT guid, attr_name, cell_text FROM typed WHERE cell_text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY guid, attr_name ORDER BY exported_at DESC NULLS LAST, loaded_at DESC NULLS LAST, row_no DESC) = 1
"""

# The attribute list of the test tables with the type of each column.
_ATTRIBUTES = {
    "text": ["FireRating", "MaterialName", "Reference", "AcousticRating", "FinishColour", "SecurityRating", "Status"],
    "boolean": ["LoadBearing", "IsExternal", "Combustible", "SmokeStop", "HandicapAccessible"],
    "real": ["ThermalTransmittance", "Width", "Height", "Length", "GrossArea", "NetVolume", "GrossWeight", "PitchAngle"],
    "integer": ["NumberOfRiser", "NumberOfTreads", "StoreyCount", "GlazingLayers", "Occupancy"],
}
_TYPES = {"text": "VARCHAR", "boolean": "BOOLEAN", "real": "DOUBLE", "integer": "BIGINT"}
SQL["p1_wide"] = (
    "WITH cells AS (" + SQL["p1_found"] + ") SELECT e.guid, "
    + ", ".join(f"CAST(max(CASE WHEN attr_name = '{n}' THEN cell_text END) AS {_TYPES[k]}) AS {n}" for k, names in _ATTRIBUTES.items() for n in names)
    + " FROM (SELECT DISTINCT guid FROM ifc_property WHERE guid IS NOT NULL) e LEFT JOIN cells c ON c.guid = e.guid GROUP BY 1"
)

NESTED = r"""
WITH RECURSIVE j AS (
  SELECT tileset_id AS record_id, CASE WHEN json_valid(tileset_json) THEN CASE WHEN json_type(tileset_json) = 'VARCHAR' THEN tileset_json::JSON ->> '$' ELSE tileset_json END END AS t FROM tileset),
ok AS (SELECT record_id, t::JSON AS t FROM j WHERE t IS NOT NULL AND json_valid(t)),
tile AS (
  SELECT record_id, '0' AS node_path, '' AS parent_path, 0 AS depth, json_extract(t, '$.root') AS t FROM ok WHERE json_type(json_extract(t, '$.root')) = 'OBJECT'
  UNION ALL
  SELECT record_id, node_path || '.' || (unnest(range(len(kids))))::VARCHAR, node_path, depth + 1, unnest(kids)
  FROM (SELECT record_id, node_path, depth, CASE json_type(json_extract(t, '$.children')) WHEN 'ARRAY' THEN (json_extract(t, '$.children[*]')) WHEN 'OBJECT' THEN [json_extract(t, '$.children')] END AS kids FROM tile WHERE json_type(t) = 'OBJECT')
  WHERE kids IS NOT NULL),
tiles AS (SELECT * FROM tile WHERE json_type(t) = 'OBJECT'),
boxes AS (
  SELECT * FROM tile WHERE json_type(json_extract(t, '$.boundingVolume.box')) = 'ARRAY' AND json_array_length(json_extract(t, '$.boundingVolume.box')) = 12
  AND len(list_filter(json_extract(t, '$.boundingVolume.box[*]'), lambda x: json_type(x) IN ('DOUBLE', 'UBIGINT', 'BIGINT'))) = 12),
p AS (
  SELECT object_id AS record_id, CASE WHEN json_valid(properties) THEN CASE WHEN json_type(properties) = 'VARCHAR' THEN properties::JSON ->> '$' ELSE properties END END AS t FROM ifcobjectgeom),
sets AS (
  SELECT record_id, unnest(range(len(s))) AS k, unnest(s) AS s FROM (SELECT record_id, json_extract(t::JSON, '$[*]') AS s FROM p WHERE t IS NOT NULL AND json_valid(t) AND json_type(t) = 'ARRAY')),
pset AS (SELECT *, k::VARCHAR AS node_path FROM sets WHERE json_type(s) = 'ARRAY'),
prop AS (SELECT *, k::VARCHAR || '.' || (m - 1)::VARCHAR AS node_path FROM (SELECT record_id, k, unnest(range(len(e))) AS m, unnest(e) AS e FROM (SELECT record_id, k, json_extract(s, '$[*]') AS e FROM pset)) WHERE m > 0 AND json_type(e) = 'ARRAY')
"""
SQL["p4_found"] = NESTED + r"""
SELECT DISTINCT * FROM (
SELECT 'tile' AS rec_kind, record_id, node_path, parent_path FROM tiles
UNION ALL
SELECT 'box', record_id, node_path, parent_path FROM boxes
UNION ALL
SELECT 'pset', record_id, node_path, '' FROM pset
UNION ALL
SELECT 'prop', record_id, node_path, k::VARCHAR FROM prop)
"""
_SCALAR = "CASE WHEN json_type({0}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE {0} ->> '$' END"
SQL["p4_tiles"] = NESTED + rf"""
SELECT record_id, node_path, parent_path, depth, TRY_CAST({_SCALAR.format("json_extract(t, '$.geometricError')")} AS DOUBLE) AS geometric_error, {_SCALAR.format("json_extract(t, '$.refine')")} AS refine,
  coalesce({_SCALAR.format("json_extract(t, '$.content.uri')")}, {_SCALAR.format("json_extract(t, '$.content.url')")}) AS content_uri
FROM tiles
"""
SQL["p4_boxes"] = NESTED + " SELECT record_id, node_path, " + ", ".join(f"CAST(json_extract(t, '$.boundingVolume.box[{i}]') AS DOUBLE) AS {n}" for i, n in enumerate(["cx", "cy", "cz", "ux", "uy", "uz", "vx", "vy", "vz", "wx", "wy", "wz"])) + " FROM boxes"
SQL["p4_psets"] = NESTED + " SELECT record_id, node_path, CASE WHEN json_type(json_extract(s, '$[0]')) = 'VARCHAR' THEN json_extract(s, '$[0]') ->> '$' END AS pset_name FROM pset"
SQL["p4_props"] = NESTED + rf"""
SELECT record_id, node_path, k::VARCHAR AS parent_path, {_SCALAR.format("json_extract(e, '$[0]')")} AS prop_name, {_SCALAR.format("json_extract(e, '$[1]')")} AS prop_value,
  CASE json_type(json_extract(e, '$[1]')) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'UBIGINT' THEN 'number' END AS value_kind
FROM prop
"""

_CHAINS = r"""
WITH RECURSIVE b AS (
  SELECT id, building_parent_id AS parent, building_root_id AS root FROM building WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_modified_at DESC NULLS LAST, loaded_at DESC NULLS LAST, building_parent_id DESC NULLS LAST, building_root_id DESC NULLS LAST) = 1),
walk AS (
  SELECT id, id AS pos, parent AS up, 0 AS links, [id] AS seen, false AS closed FROM b
  UNION ALL
  SELECT w.id, b.id, b.parent, w.links + 1, list_append(w.seen, b.id), list_contains(w.seen, b.id)
  FROM walk w JOIN b ON b.id = w.up WHERE NOT w.closed),
fin AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY links DESC) = 1)
"""
SQL["p3_paths"] = _CHAINS + r"""
SELECT id, pos AS top_id, links AS depth, array_to_string(list_reverse(seen), '/') AS path FROM fin WHERE NOT closed
"""
SQL["p3_merged_paths"] = SQL["p3_paths"]
SQL["p3_descendants"] = _CHAINS + r"""
SELECT w.pos AS ancestor_id, w.id AS node_id, w.links AS distance FROM walk w JOIN fin f ON f.id = w.id WHERE NOT f.closed
"""
SQL["p3_found"] = _CHAINS.rstrip() + r""",
faults AS (
  SELECT f.id, b.root, closed,
    CASE WHEN closed THEN list_position(seen, pos) - 1 ELSE links END AS links_up,
    CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, pos), len(seen))) ELSE pos END AS top_id,
    f.up FROM fin f JOIN b ON b.id = f.id),
tj AS (SELECT tileset_id AS id, CASE WHEN json_valid(tileset_json) THEN CASE WHEN json_type(tileset_json) = 'VARCHAR' THEN tileset_json::JSON ->> '$' ELSE tileset_json END END AS t FROM tileset),
uris AS (SELECT id, unnest(regexp_extract_all(t, '"ur[il]"\s*:\s*"([^"]*/)?([^"/]+)/tileset[.]json(?:[?#][^"]*)?"', 2)) AS dir_name FROM tj WHERE t IS NOT NULL AND json_valid(t)),
tl AS (SELECT t.tileset_id AS id, min(u.id) AS parent FROM tileset t LEFT JOIN uris u ON u.dir_name = t.dir_name GROUP BY 1),
tw AS (
  SELECT id, id AS pos, parent AS up, [id] AS seen, false AS closed FROM tl
  UNION ALL
  SELECT w.id, l.id, l.parent, list_append(w.seen, l.id), list_contains(w.seen, l.id) FROM tw w JOIN tl l ON l.id = w.up WHERE NOT w.closed)
SELECT 'building' AS hier, id AS node_id,
  CASE WHEN closed AND links_up = 0 THEN 'cycle' WHEN closed THEN 'below_cycle' WHEN up IS NOT NULL THEN 'orphan' ELSE 'wrong_root' END AS fault,
  top_id, CAST(links_up AS INTEGER) AS links_up
FROM faults WHERE closed OR up IS NOT NULL OR root IS NULL OR root <> top_id
UNION ALL
SELECT 'tileset', id, CASE WHEN list_position(seen, pos) = 1 THEN 'cycle' ELSE 'below_cycle' END,
  list_min(list_slice(seen, list_position(seen, pos), len(seen))), CAST(list_position(seen, pos) - 1 AS INTEGER)
FROM tw WHERE closed
"""

SQL["p2_found"] = r"""
WITH m AS (
  SELECT feature_id, CASE layer WHEN 'BATIMENT' THEN 'HAUTEUR' ELSE 'LARGEUR' END AS field_name,
         CASE layer WHEN 'BATIMENT' THEN properties ->> '$.HAUTEUR' ELSE properties ->> '$.LARGEUR' END AS v
  FROM geojson WHERE layer IN ('BATIMENT', 'TRONCON_ROUTE') AND feature_id IS NOT NULL),
n AS (SELECT *, TRY_CAST(replace(regexp_extract(trim(v), '^([+-]?[0-9]+([.,][0-9]+)?)( *m)?$', 1), ',', '.') AS DOUBLE) AS x FROM m)
SELECT feature_id, field_name FROM n
WHERE x IS NULL OR NOT (CASE field_name WHEN 'HAUTEUR' THEN x BETWEEN 2 AND 120 ELSE x BETWEEN 1.5 AND 40 END)
"""

SQL["p2_filled"] = r"""
WITH src AS (
  SELECT feature_id, layer AS kind, coalesce(feature_code, '#' || feature_id) AS entity, commune_code AS place, vintage, coalesce(epoch_us(captured_at), -4611686018427387904) AS moment, properties AS p,
  commune_code FROM geojson WHERE feature_id IS NOT NULL),
raw AS (
  SELECT * EXCLUDE (p, commune_code), unnest(CASE kind WHEN 'BATIMENT' THEN [{'field_name': 'HAUTEUR', 'v': p ->> '$.HAUTEUR'}, {'field_name': 'NATURE', 'v': p ->> '$.NATURE'}, {'field_name': 'commune_code', 'v': commune_code}]
    WHEN 'TRONCON_ROUTE' THEN [{'field_name': 'LARGEUR', 'v': p ->> '$.LARGEUR'}, {'field_name': 'IMPORTANCE', 'v': p ->> '$.IMPORTANCE'}, {'field_name': 'NB_VOIES', 'v': p ->> '$.NB_VOIES'}, {'field_name': 'commune_code', 'v': commune_code}]
    ELSE [{'field_name': 'commune_code', 'v': commune_code}] END, recursive := true) FROM src),
num AS (SELECT *, field_name IN ('HAUTEUR', 'LARGEUR') AS is_number, TRY_CAST(replace(regexp_extract(trim(v), '^([+-]?[0-9]+([.,][0-9]+)?)( *m)?$', 1), ',', '.') AS DOUBLE) AS x FROM raw),
o AS (
  SELECT feature_id, kind, entity, place, vintage, moment, field_name, is_number,
    CASE WHEN field_name = 'HAUTEUR' AND x BETWEEN 2 AND 120 OR field_name = 'LARGEUR' AND x BETWEEN 1.5 AND 40 THEN x END AS num,
    CASE WHEN NOT is_number AND lower(trim(v)) NOT IN ('', 'n/a', 'na', 'n.a.', '#n/a', 'nan', 'null', 'none', 'nil', '*', '$', '-', '--', '---', 'unset', '?', '??', 'nc', 'inconnu', 'undefined', 'notdefined') THEN trim(v) END AS cat
  FROM num),
s AS (SELECT *, num IS NULL AND cat IS NULL AS missing, CASE WHEN num IS NOT NULL OR cat IS NOT NULL THEN {'moment': moment, 'num': num, 'cat': cat} END AS seen FROM o),
w AS (
  SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY field_name, entity ORDER BY moment, feature_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(seen IGNORE NULLS) OVER (PARTITION BY field_name, entity ORDER BY moment, feature_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s),
d AS (SELECT *, (moment - p.moment) / 86400e6 AS back, (n.moment - moment) / 86400e6 AS ahead, is_number AND p.num IS NOT NULL AND n.num IS NOT NULL AS two FROM w WHERE missing),
e AS (SELECT *, least(back, ahead) AS gap, CASE WHEN ahead IS NULL OR coalesce(back <= ahead, false) THEN p ELSE n END AS pick FROM d),
f AS (
  SELECT *, CASE WHEN two THEN 'interpolated' WHEN gap <= 1098 THEN 'carried' END AS method FROM e),
g AS (SELECT kind, place, vintage, field_name, is_number, cat, count(*) AS n, sum(CAST(round(num * 1e6) AS BIGINT)) AS s FROM o WHERE (num IS NOT NULL OR cat IS NOT NULL) AND (field_name <> 'commune_code' OR place IS NOT NULL) GROUP BY ALL),
"""
_GROUPS = [("group_place_vintage", "kind, place, vintage"), ("group_place", "kind, place"), ("group_vintage", "kind, vintage"), ("group_kind", "kind")]
for _k, (_name, _keys) in enumerate(_GROUPS):
    SQL["p2_filled"] += f"""
n{_k} AS (SELECT {_keys}, field_name, floor(CAST(sum(s) AS DOUBLE) / sum(n) / 100000 + 0.5) / 10.0 AS num FROM g WHERE is_number GROUP BY ALL),
c{_k} AS (SELECT {_keys}, field_name, cat FROM (SELECT {_keys}, field_name, cat, sum(n) AS n FROM g WHERE NOT is_number GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_keys}, field_name ORDER BY n DESC, cat) = 1),"""
SQL["p2_filled"] += """
r AS (SELECT f.feature_id, f.field_name, f.method AS m, f.gap, f.two, f.is_number, f.p, f.n, f.pick, f.moment, """ + ", ".join(f"n{k}.num AS num{k}, c{k}.cat AS cat{k}" for k in range(4)) + " FROM f " + " ".join(
    f"LEFT JOIN {x}{k} ON " + " AND ".join(f"f.{c} IS NOT DISTINCT FROM {x}{k}.{c}" if c == "kind" else f"f.{c} = {x}{k}.{c}" for c in [*keys.split(", "), "field_name"]) for k, (_, keys) in enumerate(_GROUPS) for x in "nc"
) + """)
SELECT feature_id, field_name,
  CASE WHEN two THEN floor((p.num + (n.num - p.num) * CASE WHEN n.moment > p.moment THEN (moment - p.moment) / (n.moment - p.moment) ELSE 0.5 END) * 1000 + 0.5) / 1000.0 WHEN m = 'carried' AND is_number THEN pick.num WHEN m IS NULL THEN coalesce(num0, num1, num2, num3) END AS num,
  CASE WHEN m = 'carried' AND NOT is_number THEN pick.cat WHEN m IS NULL THEN coalesce(cat0, cat1, cat2, cat3) END AS cat,
  coalesce(m, """ + ", ".join(f"CASE WHEN num{k} IS NOT NULL OR cat{k} IS NOT NULL THEN '{name}' END" for k, (name, _) in enumerate(_GROUPS)) + """, 'none') AS method,
  CASE WHEN m IS NOT NULL THEN floor(gap * 1000 + 0.5) / 1000.0 END AS gap_days
FROM r
"""

_LOCATIONS = r"""
WITH f AS (
  SELECT feature_id, feature_code, geometry.geom_type AS g, geometry.coordinates AS c FROM geojson WHERE json_valid(geometry.coordinates)),
part AS (SELECT feature_id, feature_code, CASE WHEN starts_with(g, 'Multi') THEN json_extract(c::JSON, '$[0]')::VARCHAR ELSE c END AS c FROM f),
pt AS (SELECT feature_id, feature_code, unnest(regexp_extract_all(c, '\[[ ]*([-+0-9.eE]+)[ ]*,[ ]*([-+0-9.eE]+)', 1))::DOUBLE AS a, unnest(regexp_extract_all(c, '\[[ ]*([-+0-9.eE]+)[ ]*,[ ]*([-+0-9.eE]+)', 2))::DOUBLE AS b FROM part),
xy AS (SELECT feature_id, feature_code, CASE WHEN a > 4e6 THEN b ELSE a END AS x, CASE WHEN a > 4e6 THEN a ELSE b END AS y FROM pt),
loc AS (SELECT feature_id, any_value(feature_code) AS code, CAST(round((min(x) + max(x)) / 2 * 10000) AS BIGINT) AS x, CAST(round((min(y) + max(y)) / 2 * 10000) AS BIGINT) AS y FROM xy GROUP BY 1)
"""
SQL["p5_locations"] = _LOCATIONS + "SELECT feature_id, round(x / 10000, 4) AS x, round(y / 10000, 4) AS y FROM loc"
_AROUND = _LOCATIONS.rstrip() + r""",
cells AS (SELECT *, x // 50000 AS cx, y // 50000 AS cy FROM loc),
around AS (SELECT c.*, c.cx + dx.v AS nx, c.cy + dy.v AS ny FROM cells c, (SELECT unnest([-1, 0, 1]) AS v) dx, (SELECT unnest([-1, 0, 1]) AS v) dy),
ring AS (SELECT zone_id, list_transform(ring, lambda p: {'x': CAST(round(p.x * 10000) AS BIGINT), 'y': CAST(round(p.y * 10000) AS BIGINT)}) AS r FROM loa_zone),
edge AS (SELECT zone_id, unnest(r) AS a, unnest(list_append(r[2:], r[1])) AS b FROM ring),
side AS (
  SELECT l.feature_id, e.zone_id, CAST(e.b.x - e.a.x AS HUGEINT) * (l.y - e.a.y) - CAST(e.b.y - e.a.y AS HUGEINT) * (l.x - e.a.x) AS z, l.x, l.y, e.a, e.b
  FROM loc l JOIN (SELECT zone_id, min(a.x) AS x1, max(a.x) AS x2, min(a.y) AS y1, max(a.y) AS y2 FROM edge GROUP BY 1) w ON l.x > w.x1 AND l.x < w.x2 AND l.y > w.y1 AND l.y < w.y2
  JOIN edge e ON e.zone_id = w.zone_id),
counted AS (
  SELECT zone_id, feature_id,
    sum(CASE WHEN (a.y <= y AND b.y > y AND z > 0) OR (b.y <= y AND a.y > y AND z < 0) THEN 1 ELSE 0 END) AS n,
    bool_or(z = 0 AND x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)) AS rim
  FROM side GROUP BY 1, 2)
"""
SQL["p5_zones_in_cells"] = _AROUND + "SELECT zone_id, feature_id FROM counted WHERE n % 2 = 1 AND NOT rim"
SQL["p5_found"] = _AROUND + r"""
SELECT 'near' AS rel, a.feature_id AS low_id, b.feature_id AS high_id
FROM cells a JOIN around b ON a.cx = b.nx AND a.cy = b.ny AND a.feature_id < b.feature_id AND a.code <> b.code
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 50000 * 50000::BIGINT
UNION ALL
SELECT 'zone', zone_id, feature_id FROM counted WHERE n % 2 = 1 AND NOT rim
"""

_T = SQL["p3_found"].index("SELECT 'building' AS hier")
SQL["p3_tileset_paths"] = SQL["p3_found"][:_T] + """
, tf AS (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(seen) DESC) = 1)
SELECT id, pos AS top_id, CAST(len(seen) - 1 AS INTEGER) AS depth, array_to_string(list_reverse(seen), '/') AS path FROM tf WHERE NOT closed
"""
