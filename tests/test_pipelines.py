import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from geostrata import cli
from geostrata.functions import images, mesh, tile_codec
from geostrata.operators import atlas, ifc_model, tiles
from geostrata.plans import pipelines as P
from geostrata.queries import shapes
from geostrata.sources import files

RING = [[0, 0, 5], [10, 0, 5], [10, 20, 5], [0, 20, 5], [0, 0, 5]]
HOLE = [[2, 2, 5], [4, 2, 5], [4, 4, 5], [2, 4, 5], [2, 2, 5]]


def tri_area(t):
    (ax, ay, _), (bx, by, _), (cx, cy, _) = t
    return abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2


@pytest.mark.parametrize("seed", range(6))
def test_triangulation_keeps_the_area_and_count(seed):
    r = random.Random(seed)
    n = r.randrange(5, 14)
    ring = [(100 * math.cos(2 * math.pi * k / n) * (0.6 + 0.4 * r.random()), 100 * math.sin(2 * math.pi * k / n) * (0.6 + 0.4 * r.random()), 0.0) for k in range(n)]
    holes = [[(x + 3 * dx, y + 3 * dy, 0.0) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))] for x, y in ((-20, -5), (10, 5))]
    t = mesh.triangulate(ring, holes)
    assert math.isclose(sum(map(tri_area, t)), abs(mesh.area2(ring)) / 2 - 18, rel_tol=1e-9)
    assert len(t) == n + 8 + 2 * 2 - 2


def test_rings_that_touch_or_cross_keep_the_even_odd_area():
    area = lambda *x: round(sum(map(tri_area, mesh.triangulate(*x))), 6)
    p = lambda *x: [(float(a), float(b), 0.0) for a, b in x]
    assert area(p((0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5))) == 50  # two triangles that meet in a point
    assert area(p((0, 0), (10, 10), (10, 0), (0, 10))) == 50  # a ring that crosses itself
    assert area(p((0, 0), (10, 0), (10, 10), (0, 10)), [p((-5, 4), (15, 4), (15, 6), (-5, 6))]) == 80 + 20  # a hole that cuts through: what is outside counts once
    assert area(p((0, 0), (10, 0), (10, 10), (0, 10)), [p((2, 2), (4, 2), (4, 4), (2, 4)), p((4, 2), (6, 2), (6, 4), (4, 4))]) == 92


def test_hull_buffer_and_blocks():
    assert mesh.convex_hull([(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (1, 1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    ring = mesh.buffer_line([(0, 0, 0), (10, 0, 0)], 2)
    assert sorted(p[:2] for p in ring) == [(0.0, -1.0), (0.0, 1.0), (10.0, -1.0), (10.0, 1.0)]
    assert len(mesh.block([(0, 0), (1, 0), (1, 1), (0, 1)], 0, 5)) == 2 + 8
    assert mesh.extrude([(0, 0, 0), (1, 1, 0)], [], 3) == [] and mesh.triangulate([]) == []


def test_b3dm_round_trip():
    import numpy as np

    tri = np.arange(18, dtype=np.float32).reshape(6, 3)
    data = tile_codec.encode_b3dm(tile_codec.encode_glb([{"positions": tri, "batch_ids": np.array([0, 0, 0, 1, 1, 1]), "material": 0, "normals": tile_codec.normals(tri.reshape(-1, 3, 3))}], [tile_codec.DEFAULT_MATERIAL]), 2, {"id": ["é", "b"]})
    n, table, (p,), (m,) = tile_codec.decode_b3dm(data)
    assert n == 2 and table == {"id": ["é", "b"]} and (p["positions"] == tri).all() and p["batch_ids"].tolist() == [0, 0, 0, 1, 1, 1] and m["rgba"] == [1, 1, 1, 1]
    assert len(data) % 8 == 0


@pytest.mark.parametrize("seed", range(4))
def test_atlas_has_no_overlap_and_everything_fits(seed):
    r = random.Random(seed)
    sizes = [(r.randrange(1, 40), r.randrange(1, 40)) for _ in range(30)]
    at, w, h = atlas.pack(sizes)
    seen = set()
    for (x, y), (a, b) in zip(at, sizes, strict=True):
        cells = {(x + i, y + j) for i in range(a) for j in range(b)}
        assert not cells & seen and x + a <= w and y + b <= h
        seen |= cells


def write_geojson(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


def feature(i, dx, props=None, kind="MultiPolygon"):
    shift = lambda r: [[x + dx, y, z] for x, y, z in r]
    coords = {"MultiPolygon": [[shift(RING), shift(HOLE)]], "Polygon": [shift(RING)], "LineString": shift(RING[:3]), "MultiLineString": [shift(RING[:4])]}[kind]
    return {"type": "Feature", "properties": {"ID": f"f{i}", "HAUTEUR": 10 + i, **(props or {})}, "geometry": {"type": kind, "coordinates": coords}}


def test_geojson_to_tileset_and_back(spark, tmp_path):
    fs = [feature(i, 100 * i) for i in range(3)] + [feature(3, 300, kind="LineString"), feature(4, 400, {"PREC_ALTI": 9999.0}), {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    path = write_geojson(tmp_path / "a.geojson", fs)
    o = cli.options(cli.parser().parse_args(["geojson", "-i", path, "-o", str(tmp_path / "out"), "--kd_tree_max", "1", "--lod1", "-k", "--add_color", "HAUTEUR", "numeric", "--obj", str(tmp_path / "m")]))
    t = P.geojson(spark, [path], o)
    assert len(t["root"]["children"]) == 4 and all(len(c["children"]) == 1 for c in t["root"]["children"])
    assert (tmp_path / "m.obj").read_text().count("\nf ") > 0
    back = tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / "out")])).collect()
    leaf = {r.id: r for r in back if not r.id.startswith("lod1_")}
    assert set(leaf) == {"f0", "f1", "f2", "f3"} and leaf["f1"].props["HAUTEUR"] == "11"
    xs = [p[k] for x in leaf["f1"].tri for p in (x.a, x.b, x.c) for k in (0,)]
    zs = [p.z for x in leaf["f1"].tri for p in (x.a, x.b, x.c)]
    assert (round(min(xs), 3), round(max(xs), 3)) == (100, 110) and (round(min(zs), 3), round(max(zs), 3)) == (5, 16)
    roof = [x for x in leaf["f1"].tri if min(x.a.z, x.b.z, x.c.z) > 15]
    assert math.isclose(sum(tri_area((x.a, x.b, x.c)) for x in roof), 200 - 4, rel_tol=1e-4)
    assert len({tuple(leaf[k].rgba) for k in leaf}) == 4


def test_reader_and_merger(spark, tmp_path):
    path = write_geojson(tmp_path / "a.json", [feature(0, 0), feature(1, 50)])
    for name in ("a", "b"):
        P.geojson(spark, [path], P.Options(output_dir=str(tmp_path / name), geometric_error=(7.0,)))
    assert len(P.merger([str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")], str(tmp_path / "m"))["root"]["children"]) == 4
    t = P.reader(spark, [str(tmp_path / "a"), str(tmp_path / "b")], P.Options(output_dir=str(tmp_path / "r"), offset=(1.0, 2.0, 3.0)))
    assert len(t["root"]["children"]) == 4


def test_reader_keeps_the_tree(spark, tmp_path):
    path = write_geojson(tmp_path / "a.json", [feature(0, 0), feature(1, 50)])
    t = P.geojson(spark, [path], P.Options(output_dir=str(tmp_path / "a"), geometric_error=(7.0, 9.0), lod1=True, kd_tree_max=1))
    top = t["root"]["children"][0]
    top["refine"] = "ADD"
    top["children"] = [{"boundingVolume": {"box": [0] * 12}, "geometricError": 8.0, "children": top["children"]}]  # a node without content
    (tmp_path / "a" / "tileset.json").write_text(json.dumps(t))
    shape = lambda x: (x["geometricError"], x["refine"], "content" in x, [shape(c) for c in x["children"]])
    got = P.reader(spark, [str(tmp_path / "a")], P.Options(output_dir=str(tmp_path / "r")))
    assert sorted(map(shape, got["root"]["children"])) == [(9.0, "ADD", True, [(8.0, "ADD", False, [(7.0, "REPLACE", True, [])])]), (9.0, "REPLACE", True, [(7.0, "REPLACE", True, [])])]
    xs = lambda d: {r.id: round(min(p.x for x in r.tri for p in (x.a, x.b, x.c)), 2) for r in tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / d)])).collect()}
    assert xs("r") == xs("a") and len(xs("a")) == 4
    tree = tiles.read_tree(files.tilesets(spark, [str(tmp_path / "a")]), (1.0, None, 3.0))
    assert sorted(v["geometric_error"] for v in tree.values()) == [1.0, 1.0, 3.0, 3.0, 8.0, 9.0]


def test_zones_group_features_and_give_blocks(spark, tmp_path):
    path = write_geojson(tmp_path / "a.geojson", [feature(i, 100 * i) for i in range(3)])
    zone = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[-5, -5], [200, -5], [200, 50], [-5, 50], [-5, -5]]]}}
    zones = write_geojson(tmp_path / "z.geojson", [zone, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}])
    t = P.geojson(spark, [path], P.Options(output_dir=str(tmp_path / "o"), loa=zones, scale=2.0, height_mult=0.5))
    assert t["root"]["children"][0]["geometricError"] == 20.0


@pytest.mark.parametrize("lod1", [False, True])
def test_a_zone_dealt_out_over_tiles_has_one_block(spark, tmp_path, monkeypatch, lod1):
    path = write_geojson(tmp_path / "a.geojson", [feature(i, 20 * i) for i in range(15)])
    zones = write_geojson(tmp_path / "z.geojson", [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[-5, -5], [235, -5], [235, 50], [-5, 50], [-5, -5]]]}}])
    got = []
    for most in (100, 5):
        monkeypatch.setattr(tiles, "GROUP_FEATURES", most)
        out = str(tmp_path / f"o{most}")
        t = P.geojson(spark, [path], P.Options(output_dir=out, loa=zones, lod1=lod1))
        back = tiles.read_tiles(spark, files.tilesets(spark, [out])).collect()
        points = lambda r: sorted((round(p.x, 2), round(p.y, 2), round(p.z, 2)) for x in r.tri for p in (x.a, x.b, x.c))
        got.append(sorted((r.id, points(r)) for r in back))
    assert len(t["root"]["children"]) == 2 and {len(c["children"]) for c in t["root"]["children"]} == {1, 3}
    assert [i for i, _ in got[0]] == [i for i, _ in got[1]] and got[0][0][0] == "f0"
    for (_, a), (_, b) in zip(*got, strict=True):
        assert all(math.isclose(p, q, abs_tol=0.02) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))


def test_obj_meshes(spark, tmp_path):
    (tmp_path / "c.mtl").write_text("newmtl red\nKd 1 0 0\nd 0.5\n")
    (tmp_path / "c.obj").write_text("mtllib c.mtl\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nusemtl red\nf 1 2 3 4\n")
    (tmp_path / "d.obj").write_text("v 0 0 0\n")
    f, _, _ = files.obj(spark, [str(tmp_path)])
    assert [(r.id, len(r.tri), r.rgba, r.colors) for r in f.collect()] == [("red", 2, [1, 0, 0, 0.5], None)]
    assert len(P.obj(spark, [str(tmp_path)], P.Options(output_dir=str(tmp_path / "o"), crs_out="EPSG:4978"))["root"]["children"]) == 1


def test_options_and_paths(tmp_path):
    assert P.offset_of(["1", "2"]) == (1.0, 2.0, 0.0) and P.offset_of(["centroid"]) == "centroid" and P.errors_of(["3", "x"]) == (3.0, None)
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.txt").write_text("")
    assert files.expand([str(tmp_path)], files.GEOJSON) == [str(tmp_path / "b.json")]
    with pytest.raises(FileNotFoundError):
        files.expand([str(tmp_path)], files.OBJ)
    assert files.rgba("#ff0080") == [1.0, 0.0, 0.502, 1.0] and len(files.ramp(files.colors())) == 20


def test_well_known_binary():
    import struct

    ring = [(0, 0, 0), (0, 4, 0), (0, 4, 3), (0, 0, 3), (0, 0, 0)]
    poly = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<3d", *p) for p in ring)
    multi = struct.pack("<BII", 1, 1006, 1) + poly
    t = mesh.wkb_triangles(multi)
    assert len(t) == 2 and {p[0] for x in t for p in x} == {0.0} and mesh.wkb_triangles(b"\x01\x01") is None and mesh.wkb_triangles(None) is None


def picture(seed, h, w):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_png_layout():
    import struct
    import zlib

    import numpy as np

    a = picture(0, 9, 5)
    assert (images.decode_png(images.encode_png(a, 99))[..., :3] == a).all() and images.decode_png(b"\xff\xd8") is None and images.decode_png(None) is None and images.decode_png(images.SIGNATURE) is None
    chunk = images._chunk
    head = lambda color, h, w: images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
    rows = a.astype(int)
    # every filter on one line each, made from its definition
    out = b""
    flat = rows.reshape(9, -1)
    for y in range(9):
        kind, line = y % 5, []
        for i, x in enumerate(flat[y]):
            left, up, both = (flat[y, i - 3] if i >= 3 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i >= 3 else 0)
            p = left + up - both
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - both), 2, both))[2]
            line.append((x - [0, left, up, (left + up) // 2, nearest][kind]) % 256)
        out += bytes([kind, *line])
    assert (images.decode_png(head(2, 9, 5) + chunk(b"IDAT", zlib.compress(out)))[..., :3] == a).all()
    indexed = head(3, 1, 2) + chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", bytes([9])) + chunk(b"IDAT", zlib.compress(bytes([0, 1, 0])))
    assert images.decode_png(indexed).tolist() == [[[4, 5, 6, 255], [1, 2, 3, 9]]]
    half = images.smaller(np.repeat(np.repeat(picture(1, 8, 4), 3, axis=0), 3, axis=1), 3)
    assert half.shape == (8, 4, 3) and (half == picture(1, 8, 4)).all()


def test_textures_crop_into_sheets_and_back(spark, tmp_path):
    import numpy as np

    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        (src / f"t{k}.png").write_bytes(images.encode_png(picture(k, 16, 8)))
        (src / f"m{k}.mtl").write_text(f"newmtl m{k}\nKd 1 1 1\nmap_Kd .\\t{k}.png\n")
        (src / f"c{k}.obj").write_text(f"mtllib m{k}.mtl\nv {9 * k} 0 0\nv {9 * k + 1} 0 0\nv {9 * k + 1} 1 0\nvt 0.25 0.25\nvt 0.75 0.25\nvt 0.75 0.75\nusemtl m{k}\nf 1/1 2/2 3/3\n")
    t = P.obj(spark, [str(src)], P.Options(output_dir=str(tmp_path / "o"), with_texture=True, texture_lods=1))
    top = t["root"]["children"][0]
    assert [x["geometricError"] for x in (top, top["children"][0])] == [2.0, 1.0] and sorted(p.name for p in (tmp_path / "o" / "tiles").iterdir() if p.suffix == ".png") == [f"ATLAS_{k}.png" for k in range(4)]
    leaf = tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / "o")])).filter("node_path like '0._.0'").collect()
    assert len(leaf) == 4 and {r.texture.rpartition("/")[2] for r in leaf} == {"ATLAS_1.png", "ATLAS_3.png"}
    for r in leaf:
        with open(r.texture, "rb") as f:
            sheet = images.decode_png(f.read())
        uv = np.array([[q.u, q.v] for x in r.uv for q in (x.a, x.b, x.c)])
        part, _ = images.cropped(sheet, uv)
        whole = picture(int(r.id[1]), 16, 8)
        assert (part[..., :3] == whole[4:12, 2:6]).all()
    P.reader(spark, [str(tmp_path / "o")], P.Options(output_dir=str(tmp_path / "r"), with_texture=True))
    assert any(p.suffix == ".png" for p in (tmp_path / "r" / "tiles").iterdir())
    P.merger([str(tmp_path / "o"), str(tmp_path / "o")], str(tmp_path / "m"))
    own = list((tmp_path / "m" / "tiles").iterdir())
    assert sum(p.suffix == ".png" for p in own) == 8
    for p in own:
        if p.suffix == ".b3dm":
            (name,) = tile_codec.pictures(p.read_bytes())
            assert (p.parent / name).exists() and len(p.read_bytes()) % 8 == 0 and tile_codec.decode_b3dm(p.read_bytes())[3][0]["texture"] == name
    P.obj(spark, [str(src)], P.Options(output_dir=str(tmp_path / "n")))
    assert not any(p.suffix == ".png" for p in (tmp_path / "n" / "tiles").iterdir())


def test_models_as_levels_of_detail(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"c{k}.obj").write_text(f"v 0 0 0 1 0 0\nv 1 0 0 0 1 0\nv 1 1 {k} 0 0 1\nf 1 2 3\n")
    t = P.obj(spark, [str(tmp_path)], P.Options(output_dir=str(tmp_path / "o"), as_lods=True, geometric_error=(1.0, 5.0), obj=str(tmp_path / "out")))
    chain = lambda x: [x["geometricError"], *(y for c in x["children"] for y in chain(c))]
    assert [chain(x) for x in t["root"]["children"]] == [[1.0, 5.0, 1.0]]
    back = tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / "o")])).collect()
    assert all(r.colors[0].b.g == 1.0 for r in back) and len(back) == 3
    text = (tmp_path / "out.obj").read_text()
    assert text.splitlines()[0].split() == ["v", "0.0", "0.0", "0.0", "1.0", "0.0", "0.0"] and "vn 0.0 0.0 1.0" in text and text.count("\nf ") == 3 and "//" in text


def test_large_tilesets_are_trees_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiles, "DOCUMENT_TILES", 4)
    path = write_geojson(tmp_path / "a.json", [feature(i, 50 * i) for i in range(9)])
    t = P.geojson(spark, [path], P.Options(output_dir=str(tmp_path / "o"), kd_tree_max=1, lod1=True))
    docs = [json.loads((tmp_path / "o" / c["content"]["uri"]).read_text()) for c in t["root"]["children"]]
    tops = [c for d in docs for c in d["root"]["children"]]
    assert len(docs) == 5 and len(tops) == 9 and all((tmp_path / "o" / "tilesets" / c["content"]["uri"]).exists() and len(c["children"]) == 1 for c in tops)
    box = lambda x: x["boundingVolume"]["box"]
    for d, c in zip(docs, t["root"]["children"], strict=True):
        assert [round(v, 3) for v in box(d["root"])] == [round(v, 3) for v in box(c)]


def city_folder(spark, tmp_path):
    p3 = "array<struct<a:struct<x:double,y:double,z:double>,b:struct<x:double,y:double,z:double>,c:struct<x:double,y:double,z:double>>>"
    p2 = "array<struct<a:struct<u:double,v:double>,b:struct<u:double,v:double>,c:struct<u:double,v:double>>>"
    tri = lambda x, z: [((x, 0.0, z), (x + 1, 0.0, z), (x + 1, 1.0, z))]
    uv = [((0.0, 1.0), (0.5, 1.0), (0.5, 0.5))]
    rows = {
        "building": ([(1, 1, None, 26), (2, 1, 1, 25), (3, 3, None, 26)], "id long, building_root_id long, building_parent_id long, objectclass_id int"),
        "thematic_surface": ([(10, 2, 100, 33), (11, 2, 101, 34), (12, 3, 102, 33)], "id long, building_id long, lod2_multi_surface_id long, objectclass_id int"),
        "surface_geometry": ([(1000 + k, 100 + k, tri(9.0 * k, float(k))) for k in range(3)], f"id long, root_id long, tri {p3}"),
        "cityobject": ([(i, f"G{i}") for i in (1, 2, 3, 10, 11, 12)], "id long, gmlid string"),
        "objectclass": ([(25, "BuildingPart"), (26, "Building"), (33, "BuildingRoofSurface"), (34, "BuildingWallSurface")], "id int, classname string"),
        "textureparam": ([(1000 + k, 5, uv) for k in range(3)], f"surface_geometry_id long, surface_data_id long, uv {p2}"),
        "surface_data": ([(5, 6)], "id long, tex_image_id long"),
        "tex_image": ([(6, "a.png", bytearray(images.encode_png(picture(3, 8, 8))))], "id long, tex_image_uri string, tex_image_data binary"),
    }
    for n, (r, schema) in rows.items():
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / "db" / f"{n}.parquet"))
    return str(tmp_path / "db")


def test_city_hierarchies_colors_and_textures(spark, tmp_path):
    db = city_folder(spark, tmp_path)
    P.city(spark, db, P.Options(output_dir=str(tmp_path / "o"), with_BTH=True))
    _, table, _, _ = tile_codec.decode_b3dm((tmp_path / "o" / "tiles" / "0.b3dm").read_bytes())
    h = table["extensions"]["3DTILES_batch_table_hierarchy"]
    assert table["id"] == ["G1"] and h["instancesLength"] == 4 and h["parentCounts"] == [1, 1, 0, 1] and h["parentIds"] == [3, 3, 2] and h["classIds"] == [0, 1, 2, 3]
    assert [c["name"] for c in h["classes"]] == ["BuildingRoofSurface", "BuildingWallSurface", "Building", "BuildingPart"] and h["classes"][0]["instances"]["gmlid"] == ["G10"]
    P.city(spark, db, P.Options(output_dir=str(tmp_path / "c"), split_surfaces=True, add_color=("", "semantic")))
    back = tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / "c")])).collect()
    assert sorted({tuple(r.rgba) for r in back}) == [(0.8549, 0.498, 0.1255, 1.0), (1.0, 1.0, 1.0, 1.0)] and len(back) == 3
    P.city(spark, db, P.Options(output_dir=str(tmp_path / "t"), with_texture=True))
    assert (tmp_path / "t" / "tiles" / "ATLAS_0.png").exists()


def test_building_information_from_tables(spark, tmp_path):
    box = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    schema = "object_id long, guid string, classe string, ifc_group string, ifc_space string, object_name string, properties string, container_class string, vertices array<struct<x:double,y:double,z:double>>, faces array<array<int>>, diffuse array<double>"
    rows = [(1, "a", "IfcSpace", None, None, "S", "[]", None, box, [[0, 1, 2]], [1.0, 0.0, 0.0]), (2, "b", "IfcWall", "g", "S", "w", None, "IfcSpace", box, [[0, 1, 2], [0, 1, 9]], None), (3, "c", "IfcWall", None, "floor", "w", None, "IfcBuildingStorey", box, [[0, 2, 1]], [0.0, 0.5, 0.0, 0.3]), (4, "d", "IfcWall", None, None, None, None, None, None, None, None)]
    objects = spark.createDataFrame(rows, schema)
    t = P.ifc(spark, objects, P.Options(output_dir=str(tmp_path / "o"), grouped_by="IfcSpace"))
    back = tiles.read_tiles(spark, files.tilesets(spark, [str(tmp_path / "o")])).collect()
    assert len(t["root"]["children"]) == 2 and {r.id: (r.props["space"] if "space" in r.props else None, len(r.tri), r.node_path) for r in back}.keys() == {"a", "b", "c"}
    by = {r.id: r for r in back}
    assert by["a"].node_path == by["b"].node_path != by["c"].node_path and [round(x, 3) for x in by["c"].rgba] == [0.0, 0.5, 0.0, 1.0] and len(by["b"].tri) == 1
    link = lambda *x: spark.createDataFrame(list(x), "id long, parent long")
    up = ifc_model.parents(link((1, 5), (2, None)), link((1, 6), (3, 7)), link((3, 8), (5, 9)))
    assert sorted(tuple(r) for r in up.collect()) == [(1, 5), (3, 8), (5, 9)]
    chain = ifc_model.ancestor_chain(up.unionByName(link((9, None))))
    assert sorted(tuple(r) for r in chain.collect()) == [(1, 1, 5), (1, 2, 9), (5, 1, 9)]
    p = spark.createDataFrame([("g", "B", "n", 'a"b', 3), ("g", "A", "x", None, 1), ("g", "B", "m", "1", 2), ("g", None, "k", "v", 9), (None, "A", "x", "y", 1)], "guid string, pset_name string, prop_name string, prop_value string, row_no long")
    assert [json.loads(r.properties) for r in ifc_model.property_sets(p).collect()] == [[["A", ["x", None]], ["B", ["m", "1"], ["n", 'a"b']], [None, ["k", "v"]]]]


def test_unknown_geometries_are_errors(spark):
    f = spark.createDataFrame([("Point", "[1,2]")], "t string, c string")
    with pytest.raises(Exception, match="no geometry of type"):
        f.select(files.rings(F.col("t"), F.col("c"), strict=True)).collect()
    assert f.select(files.rings(F.col("t"), F.col("c")).alias("r")).first().r is None


def odd_geojson(spark, folder):
    """A geojson table of empty coordinates, and of a hole that cuts through its ring."""
    rows = [
        ("LineString", "[[]]"), ("LineString", "[]"), ("MultiLineString", "[]"), ("MultiLineString", "[[]]"), ("Polygon", "[]"), ("Polygon", "[[]]"), ("MultiPolygon", "[]"), ("MultiPolygon", "[[]]"), ("LineString", None), ("Polygon", ""),
        ("LineString", "[[0,0],[10,0,5]]"), ("Polygon", "[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[-5,4],[15,4],[15,6],[-5,6]]]"), ("LineString", "[[1,1]]"),
    ]
    rows = [(i, "BATIMENT" if "Polygon" in k else "TRONCON_ROUTE", "{}", (k, c)) for i, (k, c) in enumerate(rows)]
    spark.createDataFrame(rows, "feature_id long, layer string, properties string, geometry struct<geom_type:string,coordinates:string>").coalesce(1).write.parquet(f"{folder}/geojson.parquet")
    return str(folder)


def twin(name, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW geojson AS SELECT * FROM read_parquet('{folder}/geojson.parquet/*.parquet')")
    return sorted(db.execute(shapes.SQL[name]).fetchall())


def test_solids_of_empty_coordinates_and_of_holes_outside(spark, tmp_path):
    d = odd_geojson(spark, tmp_path)
    found = sorted(tuple(r) for r in shapes.geojson_solids(spark, d).collect())
    assert found == twin("geojson_solids", d) == [(0, 0.0), (10, 20.0), (11, 60.0), (12, 0.0)]


def test_buffers_of_empty_lines(spark, tmp_path):
    d = odd_geojson(spark, tmp_path)
    assert sorted(tuple(r) for r in shapes.line_buffer(spark, d).collect()) == twin("line_buffer", d) == [(10, 4, 20.0)]


def test_contents_without_the_features_of_empty_coordinates(spark, tmp_path):
    r = shapes.tile_contents(spark, odd_geojson(spark, tmp_path)).orderBy("tile").collect()
    assert [(x.tile, x.n_features, x.zmin, x.zmax) for x in r] == [(0, 1, -7.5, 7.5), (1, 1, -5.0, 5.0)]


def test_packing_goes_on_where_the_tree_of_cuts_does():
    def tree(free, w, h):
        """(left, top) in a list of nested free rectangles, first come first served."""
        for k, x in enumerate(free):
            if isinstance(x, list):
                if at := tree(x, w, h):
                    return at
            elif w <= x[2] and h <= x[3]:
                left, top, a, b = x
                below, beside = (left, top + h + 1, w, b - h - 1), (left + w + 1, top, a - w - 1, b)
                free[k] = [below, beside] if a - w >= b - h else [(left + w + 1, top, a - w - 1, h), (left, top + h + 1, a, b - h - 1)]
                return left, top
        return None

    for seed in range(20):
        r = random.Random(seed)
        sizes = [(r.randint(1, 9), r.randint(1, 30)) for _ in range(300)]
        at, w, h = atlas.pack(sizes)
        free = [(0, 0, w, h)]
        places = {i: tree(free, *sizes[i]) for i in sorted(range(300), key=lambda i: -sizes[i][0] * sizes[i][1])}
        assert at == [places[i] for i in range(300)]


def test_packing_of_many_images_in_a_row():
    at, w, h = atlas.pack([(1, 3000)] * 3000)  # a cut in a cut, 3,000 deep
    assert (w, h) == (8192, 4096) and at == [(2 * i, 0) for i in range(3000)]
    at, _, _ = atlas.pack([(k % 50 + 1, k % 50 + 4) for k in range(20_000)])
    assert len(set(at)) == 20_000


def test_faces_are_joined_without_broadcasts(spark, tmp_path):
    spark.createDataFrame([(i, 1 + i, 100.0 + i) for i in range(3)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    f = shapes.T.obj_faces(spark, str(tmp_path))
    # sizes are guessed without what is exploded: a broadcast side would be as large as the mesh
    assert "BroadcastHashJoin" not in f._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in f.limit(99).collect())[:2] == [(0, 1, 2, 3), (1, 1, 3, 4)]
