import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.functions import measures as M
from geostrata.operators import fill, grouping, kdtree, lineage, near, nested, wide_table

T0 = dt.datetime(2020, 1, 1)
PROP = "row_no long, guid string, model_file string, pset_name string, prop_name string, prop_value string, exported_at timestamp, loaded_at timestamp, attr_name string"
ATTR = [("Width", "real", "m", ["Breite"]), ("Flag", "boolean", None, None), ("Count", "integer", None, []), ("Name", "text", None, []), ("guid", "text", None, [])]


def props(spark, rows):
    return spark.createDataFrame([(i, g, "m", None, n, v, None if t is None else T0 + dt.timedelta(days=t), T0, "clash") for i, (g, n, v, t) in enumerate(rows)], PROP)


def attrs(spark):
    return spark.createDataFrame(ATTR, "attr_name string, data_kind string, base_unit string, alt_names array<string>")


def test_wide_table_takes_the_newest_readable_value(spark):
    rows = [
        ("a", "WIDTH", "1,5 m", 1), ("a", "bre-ite", "20 cm", 2), ("a", "Width", "x", 3), ("a", "width", "n/a", 4), ("a", "flag", "IFCBOOLEAN(.T.)", None), ("a", "count", "7.0", 1), ("a", "Count", "2.5", 2),
        ("a", "name", "IFCLABEL(' it''s ')", 1), ("a", "guid", "own", 1), ("b", "other", "1", 1), ("b", None, "1", 1), ("c", "Name", None, 1), (None, "Name", "x", 1), ("a", "name", "", 9), ("d", "Name", "x" * 200_000, 1), ("d", "Name", "x" * 200_000, 1),
        ("d", "Count", "900000000000000001", 1), ("d", "Width", "12345678901234567890,5", 1), ("d", "Count", "9" * 25, 2), ("d", "Width", "9" * 40, 3),
    ]
    wide, a = wide_table.widen(props(spark, rows), attrs(spark))
    got = {r.guid: r for r in wide.collect()}
    assert set(got) == {"a", "b", "c", "d"} and sorted(r.entity_ordinal for r in got.values()) == [0, 1, 2, 3]
    assert (str(got["a"].Width), got["a"].Flag, got["a"].Count, got["a"].Name, got["a"].guid_attr) == ("0.200", True, 7, "it''s", "own")
    assert (got["d"].Count, str(got["d"].Width)) == (900000000000000001, "12345678901234567890.500") and got["b"].Width is None and got["c"].Name is None and len(got["d"].Name) == 200_000
    cells = {tuple(r) for r in wide_table.filled_cells(wide, a).collect() if r.guid == "a"}
    assert ("a", "Width", "0.200") in cells and ("a", "Flag", "true") in cells and ("a", "Count", "7") in cells


def test_wide_table_of_nothing(spark):
    wide, a = wide_table.widen(props(spark, []), attrs(spark))
    assert wide.count() == 0 and "Width" in wide.columns
    wide, a = wide_table.widen(props(spark, [("a", "x", "1", 1)]), attrs(spark).limit(0))
    assert [r.guid for r in wide.collect()] == ["a"] and wide_table.filled_cells(wide, a).count() == 0


def test_wide_table_across_ordinal_ranges(spark, monkeypatch):
    monkeypatch.setattr(wide_table, "RANGE", 7)
    rows = [(f"g{i:03d}", "Count", str(i), 1) for i in range(60)]
    wide, _ = wide_table.widen(props(spark, rows), attrs(spark))
    got = wide.collect()
    assert sorted(r.entity_ordinal for r in got) == list(range(60)) and all(r.guid == f"g{r.Count:03d}" for r in got)


@pytest.mark.parametrize(("text", "unit", "want"), [("1 048,574", "m3", 1048.574), ("1.234,5", "m", 1234.5), ("1,234.5", "m", 1234.5), ("1.32e-01", "m", 0.132), ("12 apples", "m", None), ("1.2.3", "m", None), ("0.5 W/(m²K)", "W/m2K", 0.5), ("0.011198 t", "kg", 11.198), ("", "m", None), (None, "m", None), ("-", None, None), ("7°", None, 7.0), ("+3", "m", 3.0), ("123456789012345", "m", 123456789012345.0), ("900000000000000001 mm", "m", 900000000000000.0), ("1e15", "m", 1e15), ("0.0000005 km", "m", 0.0005), ("1e40", "m", None)])
def test_measures(spark, text, unit, want):
    got = spark.createDataFrame([(text, unit)], "t string, u string").select(M.measure(F.col("t"), F.col("u")).cast("double")).first()[0]
    assert got == want


GEO = "feature_id long, layer string, feature_code string, vintage int, commune_code string, properties string, captured_at timestamp"


def geo(spark, rows):
    return spark.createDataFrame([(i, la, c, v, p, json.dumps(x) if isinstance(x, dict) else x, None if t is None else T0 + dt.timedelta(days=t)) for i, la, c, v, p, x, t in rows], GEO)


def test_fill_interpolates_carries_and_falls_back(spark):
    rows = [
        (1, "BATIMENT", "a", 2012, "x", {"HAUTEUR": 10, "NATURE": "Silo"}, 0), (2, "BATIMENT", "a", 2013, "x", {"HAUTEUR": None}, 10), (3, "BATIMENT", "a", 2014, "x", {"HAUTEUR": "20,0 m", "NATURE": ""}, 20),
        (4, "BATIMENT", "b", 2012, "x", {}, 0), (5, "BATIMENT", None, 2012, "y", None, None), (6, "TRONCON_ROUTE", "c", 2012, "x", {"LARGEUR": 99}, 0), (7, None, "d", 2012, None, "{", 3), (8, "BATIMENT", "a", 2025, "x", {"HAUTEUR": 3}, 9999), (None, "BATIMENT", "a", 1, "x", {}, 0),
    ]
    got = {(r.feature_id, r.field_name): r for r in fill.fill(geo(spark, rows)).collect()}
    assert (got[2, "HAUTEUR"].num, got[2, "HAUTEUR"].method, got[2, "HAUTEUR"].gap_days) == (15.0, "interpolated", 10.0)
    assert (got[2, "NATURE"].cat, got[2, "NATURE"].method) == ("Silo", "carried") and got[1, "HAUTEUR"].method == "observed"
    assert (got[4, "HAUTEUR"].method, got[4, "HAUTEUR"].num) == ("group_place_vintage", 10.0) and got[5, "HAUTEUR"].method == "group_vintage"
    assert got[6, "LARGEUR"].method == "none" and (7, "commune_code") in got and (7, "HAUTEUR") not in got
    assert got[8, "NATURE"].method == "group_place"


def test_fill_is_the_same_in_parts_of_any_size(spark):
    r = random.Random(5)
    rows = [(i, "BATIMENT", r.choice(["hot", "hot", "hot", f"c{i % 9}"]), 2012, "x", {"HAUTEUR": r.choice([None, r.randrange(3, 60)]), "NATURE": r.choice(["", "Silo", "Serre"])}, r.randrange(50)) for i in range(120)]
    obs = fill.observations(geo(spark, rows))
    key = lambda df: sorted((x.feature_id, x.field_name, x.num, x.cat, x.method, x.gap_days) for x in df.filter("field_name <> 'commune_code'").collect() if x.method)
    for rows in (7, 30):
        assert key(fill.by_time(obs)) == key(fill.by_time(obs, rows))
    assert fill.fill(geo(spark, [])).count() == 0


def test_shredding_round_trip_positions():
    doc = {"root": {"children": [None, {"children": {"v": 1}}, {"children": []}, {"boundingVolume": {"box": [1, None, 2]}}]}}
    cols = {c.path: c for c, _ in nested.shred([{"root": 7}, doc, doc], lists=frozenset({"children"}))}
    c = cols["$.root.children[].children[].v"]
    at = [*zip(*nested.positions(c.r, 2), strict=True)]
    assert [(int(nested.owners(c, 0)[k]), *map(int, at[k])) for k in range(len(c.r)) if c.d[k] == c.full] == [(1, 1, 0), (2, 1, 0)]
    box = cols["$.root.children[].boundingVolume.box[]"]
    assert box.v == [1, 2, 1, 2] and (box.d == box.full - 1).sum() == 2


@pytest.mark.parametrize("seed", range(5))
def test_positions_against_walking(seed):
    r = random.Random(seed)
    make = lambda k: None if r.random() < 0.2 else r.randrange(9) if k == 0 else [make(k - 1) for _ in range(r.randrange(4))]
    docs = [make(3) for _ in range(30)]
    want = [(n, i, j, k, x) for n, a in enumerate(docs) for i, b in enumerate(a or []) for j, c in enumerate(b or []) for k, x in enumerate(c or [])]
    cols = {c.path: c for c, _ in nested.shred(docs)}
    c = cols["$[][][]"]
    value = dict(zip(c.at.tolist(), c.v, strict=True))
    at = [*zip(nested.owners(c, 0).tolist(), *(p.tolist() for p in nested.positions(c.r, 3)), map(value.get, range(len(c.r))), strict=True)]
    assert [x for x, d in zip(at, c.d, strict=True) if d >= c.full - 1] == want


def test_nested_tables(spark):
    docs = [
        (1, json.dumps({"root": {"boundingVolume": {"box": list(range(12))}, "children": [None, {"children": {"content": {"url": "b/tileset.json"}}}, {"boundingVolume": {"box": [1.0] * 11 + [None]}, "geometricError": 2, "refine": "ADD"}]}})),
        (2, json.dumps(json.dumps({"root": {"boundingVolume": {"box": [1] * 11 + [True]}}}))), (3, None), (4, "{"), (5, "[]"), (6, "5"), (7, '{"root": null}'), (8, "[" * 50_000), (9, ""), (None, '{"root": {}}'),
    ]
    cols = nested.tile_columns(spark.createDataFrame(docs, "tileset_id long, tileset_json string"))
    got = sorted(((r.record_id or 0, r.node_path, r.parent_path, r.depth, r.geometric_error, r.refine) for r in nested.tiles(cols).collect()), key=str)
    assert got == [(0, "0", "", 0, None, None), (1, "0", "", 0, None, None), (1, "0.1", "0", 1, None, None), (1, "0.1.0", "0.1", 2, None, None), (1, "0.2", "0", 1, "2", "ADD"), (2, "0", "", 0, None, None)]
    assert [(r.record_id, r.node_path, r.box) for r in nested.boxes(cols).collect()] == [(1, "0", [float(i) for i in range(12)])]
    assert [tuple(r) for r in nested.contents(cols).collect()] == [(1, "b/tileset.json")]
    objs = [(1, json.dumps([["A", ["p", 1], None, ["q", None]], None, [], [None, ["r"]], "x"])), (2, None), (3, '[["A"'), (4, json.dumps("[[\"B\", [\"p\", {\"v\": 1}]]]")), (5, "[]"), (6, "[[]]")]
    p = nested.property_columns(spark.createDataFrame(objs, "object_id long, properties string"))
    assert sorted((r.record_id, r.node_path, r.pset_name) for r in nested.psets(p).collect()) == [(1, "0", "A"), (1, "2", None), (1, "3", None), (4, "0", "B"), (6, "0", None)]
    assert sorted((r.record_id, r.node_path, r.prop_name, r.prop_value, r.value_kind) for r in nested.prop_values(p).collect()) == [(1, "0.0", "p", "1", "number"), (1, "0.2", "q", None, "null"), (1, "3.0", "r", None, None), (4, "0.0", "p", None, "object")]
    empty = nested.tile_columns(spark.createDataFrame([], "tileset_id long, tileset_json string"))
    assert nested.tiles(empty).count() == 0 and nested.boxes(empty).count() == 0


def test_records_of_any_depth_are_read(spark):
    deep = 6000
    text = '{"root": ' + '{"children": [1, ' * deep + '{"a": "\\u00e9\\"", "b": [-1.5e3, true, null, {}, []]}' + "]}" * deep + "}"
    t = nested.tiles(nested.tile_columns(spark.createDataFrame([(1, text), (2, text[:-1]), (3, '{"root": {}}')], "tileset_id long, tileset_json string")))
    got = {(r.record_id, r.depth): r.n for r in t.selectExpr("record_id", "depth", "length(node_path) as n").collect()}
    assert len(got) == deep + 2 and got[1, deep] == 2 * deep + 1
    value = nested._read_deep('{"a": [1, {"b": "x\\n"}, [], {}, -2.5e1, true, null], "": ""}')
    assert value == {"a": [1, {"b": "x\n"}, [], {}, -25.0, True, None], "": ""}
    for bad in ("", "[1,]", '{"a" 1}', "[1] 2", '{"a": 1', "{1: 2}", "nul"):
        with pytest.raises(ValueError):
            nested._read_deep(bad)


def test_boxes_of_repeated_records_and_null_ids(spark):
    doc = lambda x: json.dumps({"root": {"boundingVolume": {"box": [x] * 12}, "children": [{"boundingVolume": {"box": [x + 1] * 12}}, {"boundingVolume": {"box": [x] * 11}}]}})
    cols = nested.tile_columns(spark.createDataFrame([(1, doc(1)), (1, doc(1)), (None, doc(3)), (None, doc(5))], "tileset_id long, tileset_json string"))
    got = sorted((r.record_id or 0, r.node_path, r.parent_path, set(r.box)) for r in nested.boxes(cols).collect())
    want = [(i, p, "0" if p == "0.0" else "", {float(x + (p == "0.0"))}) for i, x in ((1, 1), (1, 1), (0, 3), (0, 5)) for p in ("0", "0.0")]
    key = lambda x: (x[0], x[1], min(x[3]))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_near_pairs_and_zones(spark):
    r = random.Random(2)
    pts = [(i, r.choice("ab"), r.randrange(0, 300_000), r.randrange(0, 300_000)) for i in range(150)] + [(200, None, 5, 5), (201, None, 5, 5)]
    df = spark.createDataFrame(pts, "feature_id long, code string, x long, y long")
    want = {(min(p[0], q[0]), max(p[0], q[0])) for p in pts for q in pts if p[0] < q[0] and (p[1] is None or q[1] is None or p[1] != q[1]) and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 < 50_000**2}
    for size in (1000, 2):
        got = near.near_pairs(df, 5.0, size).select("low_id", "high_id").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    zone = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]), (2, None), (3, [(0.0, 0.0)]), (None, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)])]
    zones = spark.createDataFrame(zone, "zone_id long, ring array<struct<x:double,y:double>>")
    at = [(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 10.0, 10.0), (4, 11.0, 5.0), (5, 5.0, 10.0), (6, 0.0001, 9.9999)]
    p = spark.createDataFrame([(i, int(x * 10_000), int(y * 10_000)) for i, x, y in at], "feature_id long, x long, y long")
    assert sorted(tuple(x) for x in near.containing_zones(p, zones, 3.0).collect()) == [(1, 1), (1, 6)]


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        z = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if z == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        odd ^= (ay <= y < by and z > 0) or (by <= y < ay and z < 0)
    return odd


def test_zones_of_any_size_and_crowded_cells(spark):
    r = random.Random(4)
    rings = [[(r.randrange(-s, s), r.randrange(-s, s)) for _ in range(r.randrange(3, 7))] for s in (5, 40, 3000, 3000, 400_000, 400_000, 9_000_000)]
    ring = "array<struct<x:double,y:double>>"
    zones = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in z]) for i, z in enumerate(rings)], f"zone_id long, ring {ring}")
    at = [(i, r.randrange(-s, s), r.randrange(-s, s)) for i, s in enumerate([4] * 60 + [40, 3000, 400_000, 9_000_000] * 20)]
    p = spark.createDataFrame([(i, x * 10_000, y * 10_000) for i, x, y in at], "feature_id long, x long, y long")
    want = {(k, i) for i, x, y in at for k, z in enumerate(rings) if inside(x, y, z)}
    assert len(want) > 50
    for rows in (100_000, 0):
        got = [tuple(x) for x in near.containing_zones(p, zones, broadcast_rows=rows, key_rows=5).collect()]
        assert len(got) == len(want) and set(got) == want
    assert near.containing_zones(p, zones.limit(0)).count() == 0 and near.containing_zones(p.limit(0), zones).count() == 0


def test_locations(spark):
    rows = [
        (1, "MultiPolygon", "[[[[2300000,6100000],[2300010,6100000],[2300010,6100020]]],[[[0,0]]]]"), (2, "LineString", "[[6.1e6,2.3e6,1],[6100004,2300002]]"), (3, "Point", "[2300001, 6100001]"), (4, "MultiPolygon", "[[],[[[1,2]]]]"),
        (5, "Polygon", "[[[1"), (6, None, None), (7, "MultiPoint", "[[2300000,6100000],[1,1]]"), (8, "Polygon", "[]")
    ]
    df = spark.createDataFrame([(i, "c", (g, c)) for i, g, c in rows], "feature_id long, feature_code string, geometry struct<geom_type:string,coordinates:string>")
    got = {r.feature_id: (r.x / 10_000, r.y / 10_000) for r in near.locations(df).collect()}
    assert got == {1: (2300005.0, 6100010.0), 2: (2300001.0, 6100002.0), 3: (2300001.0, 6100001.0), 7: (2300000.0, 6100000.0)}


def brute_kd(points, most, depth=0):
    s = sorted(points, key=lambda p: p[1 + depth % 2])
    h = len(s) // 2
    a, b = s[:h], s[h:]
    if max(len(a), len(b)) > most:
        return brute_kd(a, most, depth + 1) + brute_kd(b, most, depth + 1)
    return [x for x in (a, b) if x]


@pytest.mark.parametrize(("n", "most", "rows"), [(1, 500, 10), (37, 4, 1000), (60, 3, 9), (0, 5, 5)])
def test_kd_tree_against_recursion(spark, n, most, rows):
    r = random.Random(n)
    pts = [(i, float(r.randrange(6)), float(r.randrange(6))) for i in range(n)]
    df = spark.createDataFrame(pts, "ord long, x double, y double")
    got = {}
    for x in kdtree.kd_tree(df, most, rows).collect():
        got.setdefault(x.tile, set()).add(x.ord)
    assert [got[k] for k in sorted(got)] == [{p[0] for p in c} for c in brute_kd(pts, most)]


def test_lineage_of_three_snapshots(spark):
    v = lineage.vertices_of(spark.createDataFrame([(x,) for x in ("1::a", "2::a", "3::a", "1::b", "1::c", "2::d", "1::e", "2::f", "2::g", None)], "globalid string"))
    e = spark.createDataFrame([(1, "1::a", "2::a", "replace", ["unchanged"]), (2, "2::a", "3::a", "replace", ["re_ided"]), (3, "1::b", "2::d", "replace", ["fused"]), (4, "1::c", "2::d", "replace", ["fused"]), (5, "1::e", "2::f", "replace", ["subdivided"]), (6, "1::e", "2::g", "replace", ["subdivided"]), (7, "1::e", "2::g", "replace", None)], "edge_id int, src string, dst string, type string, tags array<string>")
    vs, es = lineage.simplify(v, e)
    assert sorted((r.globalid, r.start_date, r.end_date) for r in vs.collect()) == [("2::d", 1, 2), ("2::f", 1, 2), ("2::g", 1, 2), ("3::a", 1, 3)] and es.count() == 0
    kinds = sorted((r.kind, tuple(r.source), tuple(r.destination)) for r in lineage.transactions(v, lineage.distinct_edges(e)).collect())
    assert kinds == [("division", ("1::e",), ("2::f", "2::g")), ("union", ("1::b", "1::c"), ("2::d",))]


def test_lookup_of_vertices_and_time_stamps(spark):
    v = lineage.vertices_of(spark.createDataFrame([("1::a",), ("2::b",)], "globalid string"))
    ask = spark.createDataFrame([("1::a",), ("1::a",), ("9::z",), (None,)], "globalid string")
    assert [r.globalid for r in lineage.lookup(v, ask).collect()] == ["1::a"] and lineage.missing_stamps(v, [1]) == [2]
    with pytest.raises(Exception, match="more than one vertex"):
        lineage.lookup(v.unionByName(v), ask).collect()


def test_subdivision_below_one_modified_ancestor(spark):
    v = lineage.vertices_of(spark.createDataFrame([(x,) for x in ("1::a", "2::b", "3::c", "3::d", "1::x", "1::y", "2::z", "3::p", "3::q")], "globalid string"))
    rows = [(1, "1::a", "2::b", "modified"), (2, "2::b", "3::c", "subdivided"), (3, "2::b", "3::d", "subdivided"), (4, "1::x", "2::z", "modified"), (5, "1::y", "2::z", "modified"), (6, "2::z", "3::p", "subdivided"), (7, "2::z", "3::q", "subdivided")]
    e = spark.createDataFrame([(i, s, d, "replace", [t]) for i, s, d, t in rows], "edge_id int, src string, dst string, type string, tags array<string>")
    vs, es = lineage.collapse_subdivisions(v, e)
    assert sorted((r.globalid, r.start_date) for r in vs.collect()) == [("1::a", 1), ("1::x", 1), ("1::y", 1), ("2::z", 2), ("3::c", 2), ("3::d", 2), ("3::p", 3), ("3::q", 3)]
    assert sorted((r.src, r.dst, tuple(r.tags)) for r in es.collect() if r.src < "1::b") == [("1::a", "3::c", ("modified",)), ("1::a", "3::d", ("modified",))] and es.count() == 6


def test_geometry_edges(spark):
    one = spark.range(1)
    tri = F.array(F.struct(G.point(0, 0, 0).alias("a"), G.point(1, 0, 0).alias("b"), G.point(0, 1, 2).alias("c")))
    r = one.select(G.bbox(tri).alias("b"), G.bbox(F.slice(tri, 1, 0)).alias("none"), G.normal(F.struct(*[G.point(1, 1, 1).alias(k) for k in "abc"])).alias("n")).first()
    assert (r.b.xmin, r.b.zmax, r.none, tuple(r.n)) == (0, 2, None, (0, 0, 1))
    lat, lon = G.conic_to_geographic(F.lit(1843466.0), F.lit(5174373.0))
    x, y = G.geographic_to_conic(lat, lon)
    got = one.select(F.round(lat, 5), F.round(lon, 5), F.round(x, 4), F.round(y, 4)).first()
    assert tuple(got) == (45.75447, 4.84422, 1843466.0, 5174373.0)
    start = [F.lit(float(v)) for v in (1843466, 5174373, 250)]
    for crs in ("EPSG:2154", "EPSG:4171", "EPSG:4978", "EPSG:3857"):
        there = one.select(*[c.alias(k) for c, k in zip(G.reproject(*start, "EPSG:3946", crs), "xyz", strict=True)]).first()
        back = one.select(*[F.round(c, 3) for c in G.reproject(*map(F.lit, there), crs, "EPSG:3946")]).first()
        assert tuple(back) == (1843466.0, 5174373.0, 250.0), crs
    for to, way in (("EPSG:1", "EPSG:3946"), ("EPSG:3946", "EPSG:1")):
        with pytest.raises(ValueError):
            G.reproject(*start, to, way)


def test_filters_and_batch_tables(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, ord int")
    assert [r.ord for r in grouping.keep_ids(f, ["a", None]).collect()] == [1] and sorted(r.ord for r in grouping.keep_ids(f, ["a"], exclude=True).collect()) == [2, 3]
    b = spark.createDataFrame([(1, 0, {"k": "x"}), (1, 1, {"j": "y"}), (2, 0, {}), (2, 1, {"k": "z"}), (3, 0, None)], "tile int, ord int, props map<string,string>")
    assert sorted((r.tile, r.key, tuple(r["values"])) for r in grouping.batch_table(b, "tile", "props", "ord").collect()) == [(1, "j", (None, "y")), (1, "k", ("x", None))]
