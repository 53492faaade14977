"""Whole runs from input files to a tileset, one function for each kind of source."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.functions import mesh, tile_codec
from geostrata.operators import citydb, grouping, ifc_model, kdtree, lineage, tiles
from geostrata.runtime import row_numbers, stored
from geostrata.sources import files


# The default colors of city objects by class.
CITY_COLORS = {
    "default_color": [1, 1, 1],
    "color_dict": {
        "BuildingRoofSurface": "#da7f20", "BuildingWallSurface": [1, 1, 1], "BuildingGroundSurface": [1, 1, 1], "Building": [1, 1, 1],
        "WaterSurface": "#3d85c6", "WaterBody": "#3d85c6", "Bridge": [0, 0, 0], "ReliefFeature": "#e2ca86", "default": [1, 1, 1],
    },
}
#: Features a tile has at most when they have textures, unless the command line says otherwise: a twentieth of the usual.
TEXTURED_MAX = kdtree.DEFAULT_MAX // 20


@dataclass(frozen=True)
class Options:
    """What the command line can say; see cli.py."""

    output_dir: str = "tileset"
    obj: str | None = None
    loa: str | None = None
    lod1: bool = False
    offset: tuple[float, float, float] | str = (0.0, 0.0, 0.0)
    scale: float = 1.0
    height_mult: float = 1.0
    crs_in: str = "EPSG:3946"
    crs_out: str = "EPSG:3946"
    no_normals: bool = False
    geometric_error: tuple[float | None, ...] = ()
    kd_tree_max: int | None = None
    with_texture: bool = False
    texture_lods: int = 0
    format: str = "png"
    quality: int = 75
    compress_level: int = 6
    with_BTH: bool = False
    keep_ids: tuple[str, ...] = ()
    exclude_ids: tuple[str, ...] = ()
    as_lods: bool = False
    height: str = "HAUTEUR"
    width: str = "LARGEUR"
    z: str = "NONE"
    prec: str = "PREC_ALTI"
    is_roof: bool = False
    keep_properties: bool = False
    add_color: tuple[str, str] | None = None
    color_config: str | None = None
    city_type: str = "building"
    split_surfaces: bool = False
    grouped_by: str = "IfcTypeObject"
    time_stamps: tuple[int, ...] = ()
    temporal_graph: tuple[str, ...] = ()


def offset_of(values: list[str] | None) -> tuple[float, float, float] | str:
    """Three numbers, padded with 0 or cut; or the word centroid."""
    if not values:
        return (0.0, 0.0, 0.0)
    if values[0] == "centroid":
        return "centroid"
    v = [float(x) for x in values[:3]]
    return tuple(v + [0.0] * (3 - len(v)))


def errors_of(values: list[str] | None) -> tuple[float | None, ...]:
    """Geometric errors of leaf, extruded footprint and zone; what is no number keeps its default."""

    def one(x: str) -> float | None:
        try:
            return float(x)
        except ValueError:
            return None

    return tuple(one(x) for x in values or ())


def transformed(features: DataFrame, o: Options) -> DataFrame:
    """Height factor, scale about the tree's centroid, and projection of the features' triangles."""
    f = features
    if o.height_mult != 1.0:
        f = f.withColumn("tri", G.multiply_height(F.col("tri"), F.lit(float(o.height_mult))))
    if o.scale != 1.0:
        boxed = f.select("tile", G.bbox(F.col("tri")).alias("box"))
        c = grouping.tree_centroid(grouping.tile_centroids(boxed)).first()
        f = f.withColumn("tri", G.scale_about(F.col("tri"), F.lit(float(o.scale)), G.point(c.cx, c.cy, c.cz)))
    if o.crs_in != o.crs_out:
        d = (0.0, 0.0, 0.0) if o.offset == "centroid" else o.offset
        move = lambda p: G.point(*G.reproject(p["x"] + d[0], p["y"] + d[1], p["z"] + d[2], o.crs_in, o.crs_out))
        f = f.withColumn("tri", G.map_points(F.col("tri"), move))
    return f


def finish(features: DataFrame, palette: list[dict], o: Options, group: str | None = None, asset: dict | None = None, folder: str | None = None, tree: dict[tuple, dict] | None = None, images: DataFrame | None = None, instances: DataFrame | None = None) -> dict:
    """Filter by id, partition, transform, derive the levels of detail and write everything.

    tree: the nodes (tileset_id, path) that features with these columns come from; each is one tile again. images(texture, data):
    the pictures that features name in 'texture'. instances(root_id, kind, id, parent_id, gmlid, classname): hierarchies of
    features by their database_id.
    """
    if o.format.lower() != "png":
        raise ValueError("sheets are written as PNG")
    f = features
    if images is None and "texture" in f.columns:
        f = f.drop("texture")
    for ids, out in ((o.keep_ids, False), (o.exclude_ids, True)):
        if ids:
            f = grouping.keep_ids(f, list(ids), "id", exclude=out)
    spark = f.sparkSession
    zones = files.zones(spark, [o.loa]) if o.loa else None
    f = stored(tiles.partitioned(f, zones, o.as_lods, group, o.kd_tree_max or (kdtree.DEFAULT_MAX if images is None else TEXTURED_MAX), tree is not None))
    if not f.limit(1).count():
        raise ValueError("no feature with a geometry is left")
    f = stored(transformed(f, o))
    e = [d if x is None else x for d, x in zip((grouping.LEAF_ERROR, grouping.LOD1_ERROR, grouping.LOA_ERROR), (*o.geometric_error, None, None, None), strict=False)]
    # reprojection has moved the offset into the points already
    shift = (0.0, 0.0, 0.0) if o.crs_in != o.crs_out and o.offset != "centroid" else o.offset
    chain = o.as_lods and not group and zones is None  # the models are each other's levels of detail
    coarse = [*([(tiles.loa(f, zones), e[2])] if o.loa else []), *([(tiles.lod1(f), e[1])] if o.lod1 else [])] if not chain else []
    extras = None if images is None else tiles.tile_images(f, images)
    if instances is not None:
        own = f.select("tile", F.col("database_id").alias("root_id")).distinct().join(instances, "root_id").drop("root_id")
        more = tiles.tile_hierarchies(own)
        extras = more if extras is None else extras.unionByName(more)
    extras = stored(extras) if extras is not None else None
    down = sorted((n["downsample"] for n in [r.asDict() for r in grouping.lod_nodes(spark.createDataFrame([(0,)], "group_id int"), o.texture_lods if images is not None and not chain else 0).collect()]), reverse=True)
    n, layers = len(coarse) + len(down), []
    for k, (own, error) in enumerate(coarse):
        layers.append((tiles.contents(tiles.with_geometry(own), palette, not o.no_normals, shift, layer=(n, k)), error))
    for k, d in enumerate(down, len(coarse)):
        layers.append((tiles.contents(f, palette, not o.no_normals, shift, extras, d, (n, k), o.compress_level), e[0] if d == 1 else d / 3 + e[0]))
    folder = folder or o.output_dir
    os.makedirs(folder, exist_ok=True)
    if o.obj:
        tiles.write_obj(f, o.obj if o.obj.endswith(".obj") else o.obj + ".obj", (0.0, 0.0, 0.0) if shift == "centroid" else shift)
    heads = {r.tile: r.head for r in f.filter("head <> tile").select("tile", "head").distinct().toLocalIterator()} if o.loa else None
    if tree is not None:
        for r in f.select("tile", "tileset_id", "node_path").distinct().toLocalIterator():
            tree[r.tileset_id, tuple(map(int, r.node_path.split(".")))]["tile"] = r.tile
    errors = None
    if chain:
        v = grouping.vertical_lods(f.select(F.col("tile").alias("group_id")).distinct(), tuple(x for x in o.geometric_error if x is not None))
        errors = tuple(r.geometric_error for r in v.orderBy("group_id").toLocalIterator())
    return tiles.write_tileset(layers, folder, asset, heads, tree, errors)


def precise(raw: DataFrame, prec: str) -> DataFrame:
    """Without features whose precision stands for none (9999 and more)."""
    return raw.filter(F.coalesce(F.get_json_object("properties", f"$.{prec}").try_cast("double"), F.lit(0.0)) < 9999)


def geojson_features(raw: DataFrame, o: Options) -> DataFrame:
    """(ord, id, properties, line, tri): footprints raised to their height; roads (line) widened and raised. Features of unusable precision, or whose first ring is empty, are left out."""
    prop = lambda k: F.get_json_object("properties", f"$.{k}")
    r = raw.withColumn("rings", files.rings(F.col("geom_type"), F.col("coordinates"))).filter(F.size(F.get("rings", F.lit(0))) > 0)
    r = precise(r, o.prec)
    r = r.withColumn("h", G.resolved(o.height, prop, 10)).withColumn("w", G.resolved(o.width, prop, 2))
    base = lambda p: G.resolved_z(o.z, prop, p["z"]) - (F.col("h") if o.is_roof else F.lit(0.0))
    r = r.withColumn("rings", F.transform("rings", lambda ring: F.transform(files.filled_points(ring), lambda p: G.point(p["x"], p["y"], base(p)))))
    e, h = G.clean_rings(G.clockwise(F.col("rings")[0]), F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), G.open_ring))
    line = F.col("geom_type").endswith("LineString")
    # the kernels get whole columns, so that no expression is copied into their arguments
    r = r.select("ord", "id", "properties", line.alias("line"), F.when(line, F.col("rings")[0]).otherwise(e).alias("ext"), F.when(line, F.array().cast("array<array<struct<x:double,y:double,z:double>>>")).otherwise(h).alias("holes"), "h", "w")
    return r.mapInPandas(_solids, "ord long, id string, properties string, line boolean, tri " + mesh.TRIANGLES)


def _solids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        tri = []
        for line, ext, holes, height, width in zip(t["line"], t["ext"], t["holes"], t["h"], t["w"], strict=True):
            ring = mesh.points_of(ext)
            if line and any(p[:2] == q[:2] for p, q in zip(ring, ring[1:], strict=False)):
                ring = []  # a line that stands still has no direction
            tri.append(mesh.rows_of(mesh.extrude_line(ring, width, height) if line else mesh.extrude(ring, [mesh.points_of(x) for x in holes], height)))
        yield t[["ord", "id", "properties", "line"]].assign(tri=tri)


def colored(features: DataFrame, o: Options) -> tuple[DataFrame, list[dict]]:
    """A material for each feature by an attribute: a ramp for numbers, one color a value for words."""
    c = files.colors(o.color_config)
    material = lambda rgba: {"rgba": rgba, "metallic": c["metallic_factor"], "roughness": c["roughness_factor"], "double_sided": c["double_sided"]}
    palette = [material(files.rgba(c["default_color"]))]
    if not o.add_color or not o.add_color[0]:
        return features.withColumn("material_index", F.lit(0)), palette
    attribute, kind = o.add_color
    v = F.get_json_object("properties", f"$.{attribute}")
    if kind == "numeric":
        f = features.withColumn("v", v.try_cast("double"))
        low, high = f.agg(F.min("v"), F.max("v")).first()
        if low is None:
            return features.withColumn("material_index", F.lit(0)), palette
        palette += [material(x) for x in files.ramp(c)]
        return f.withColumn("material_index", F.coalesce(G.ramp_index(F.col("v"), F.lit(low), F.lit(high), c["nb_colors"]), F.lit(0))).drop("v"), palette
    # of one color if all have one value, else by value
    if features.select(v.alias("v")).filter("v is not null").distinct().limit(2).count() <= 1:
        return features.withColumn("material_index", F.lit(0)), palette
    return features.withColumn("rgba", F.when(v.isNotNull(), color_of(v, c))), palette


def color_of(key, config: dict):
    """The color of a key in the color file, else its default."""
    own = config["color_dict"]
    rest = F.array(*[F.lit(x) for x in files.rgba(own.get("default", config["default_color"]))])
    named = [x for k, color in own.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in files.rgba(color)]))]
    return F.coalesce(F.try_element_at(F.create_map(*named), key), rest) if named else rest


def geojson(spark: SparkSession, paths: list[str], o: Options) -> dict:
    f = stored(geojson_features(files.geojson(spark, paths), o))
    f, palette = colored(f, o)
    if o.keep_properties:
        f = f.withColumn("props", F.from_json("properties", "map<string,string>"))
    return finish(f, palette, o)


def obj(spark: SparkSession, paths: list[str], o: Options) -> dict:
    f, palette, images = files.obj(spark, paths)
    return finish(f, palette, o, images=images if o.with_texture else None)


CITY = {
    "building": (["building", "thematic_surface", "surface_geometry", "cityobject", "objectclass"], citydb.building_surfaces, "building_root_id", "building_class", "surface_class"),
    "bridge": (["bridge", "surface_geometry", "cityobject", "objectclass"], citydb.bridge_surfaces, "bridge_root_id", "classname", "classname"),
    "relief": (["relief_feature", "relief_feat_to_rel_comp", "tin_relief", "surface_geometry", "cityobject", "objectclass"], citydb.relief_surfaces, "relief_feature_id", "classname", "classname"),
    "water": (["waterbody", "waterbod_to_waterbnd_srf", "waterboundary_surface", "surface_geometry", "cityobject", "objectclass"], citydb.water_surfaces, "waterbody_id", "body_class", "surface_class"),
}


def city_features(tables: dict[str, DataFrame], kind: str, split: bool, textured: bool = False, colors: dict | None = None) -> DataFrame:
    """(ord, id, database_id, props, tri[, uv, texture][, rgba]) of a city database's objects; geometries may be well-known binary. With textures surfaces stay apart; colors: by class."""
    _, surfaces, root, klass, part = CITY[kind]
    t = dict(tables)
    if "geometry" in t["surface_geometry"].columns:
        t["surface_geometry"] = t["surface_geometry"].select("id", "root_id", mesh.from_wkb("geometry").alias("tri"))
    s = surfaces(t)
    more = []
    if textured:
        x = citydb.textured(s, t["textureparam"], t["surface_data"], t["tex_image"])
        g = x.select(F.col("surface_id").alias("id"), F.col(part).alias("classname"), "tri", "uv", F.col("tex_image_uri").alias("texture"), F.col(root).alias("root_id"))
        more = ["uv", "texture"]
    elif split:
        g = s.select(F.col("surface_id").alias("id"), F.col(part).alias("classname"), "tri", F.col(root).alias("root_id"))
    else:
        g = citydb.merged(s, root, klass)
        g = g.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("classname", "tri"))), lambda x: x["tri"])).alias("tri"), F.min("classname").alias("classname")).withColumn("root_id", F.col("id"))
    if colors is not None:
        g = g.withColumn("rgba", color_of(F.col("classname"), colors))
        more.append("rgba")
    c = t["cityobject"].groupBy(F.col("id").alias("root_id")).agg(F.min("gmlid").alias("gmlid"))
    g = g.join(c, "root_id", "left")
    props = F.create_map(F.lit("gml_id"), F.col("gmlid"), F.lit("classe"), F.col("classname"))
    return row_numbers(g, ["id"], "ord").select("ord", F.coalesce("gmlid", F.col("id").cast("string")).alias("id"), F.col("root_id").alias("database_id"), props.alias("props"), "tri", *more)


TEXTURE_TABLES = ["textureparam", "surface_data", "tex_image"]


def city(spark: SparkSession, config: str, o: Options) -> dict:
    """A city database: objects of a type, by surface or whole, with textures, class colors and hierarchies where asked for."""
    t = files.city_tables(spark, config, [*CITY[o.city_type][0], *(TEXTURE_TABLES if o.with_texture else [])])
    colors = (CITY_COLORS | files.own_colors(o.color_config)) if o.add_color is not None else None
    f = city_features(t, o.city_type, o.split_surfaces, o.with_texture, colors)
    images = instances = None
    if o.with_texture:
        images = citydb.texture_images(f.select(F.col("texture").alias("tex_image_uri")).filter("tex_image_uri is not null"), t["tex_image"]).toDF("texture", "data")
    if o.with_BTH and o.city_type == "building":
        instances = hierarchy_rows(t)
    return finish(f, [], o, asset={"extras": {"text": f"made of {files.database_name(config)}"}}, images=images, instances=instances)


def hierarchy_rows(t: dict[str, DataFrame]) -> DataFrame:
    """(root_id, kind, id, parent_id, gmlid, classname) of surfaces and building parts with the top building they belong to."""
    t = t | {"surface_geometry": t["surface_geometry"].withColumn("tri", F.col("geometry")) if "geometry" in t["surface_geometry"].columns else t["surface_geometry"]}
    b = t["building"].select("id", "building_root_id", "building_parent_id", "objectclass_id")
    s = citydb.hierarchy_surfaces(t).join(b.select(F.col("id").alias("parent_id"), F.col("building_root_id").alias("root_id")), "parent_id").withColumn("kind", F.lit(0))
    c = t["cityobject"].groupBy("id").agg(F.min("gmlid").alias("gmlid"))
    p = b.join(c, "id").select("id", F.col("building_parent_id").alias("parent_id"), "gmlid", "objectclass_id", F.col("building_root_id").alias("root_id"), F.lit(1).alias("kind"))
    names = t["objectclass"].select(F.col("id").alias("objectclass_id"), "classname")
    return s.unionByName(p).join(names, "objectclass_id", "left").select("root_id", "kind", "id", "parent_id", "gmlid", "classname")


def temporal(spark: SparkSession, configs: list[str], o: Options) -> dict:
    """Buildings of dated databases with the lifetimes of a simplified lineage graph, and its transactions."""
    if len(configs) != len(o.time_stamps) or len(configs) < 2:
        raise ValueError("as many databases as time stamps are needed, two at least")
    v, e = lineage.simplify(*files.lineage_graph(spark, list(o.temporal_graph)))
    unknown = lineage.missing_stamps(v, list(o.time_stamps))
    if unknown:
        raise ValueError(f"time stamps of the graph that weren't named: {unknown}")
    all_ = None
    for ts, config in zip(o.time_stamps, configs, strict=True):
        f = city_features(files.city_tables(spark, config, CITY["building"][0]), "building", False).withColumn("ts", F.lit(int(ts)))
        all_ = f if all_ is None else all_.unionByName(f)
    f = all_.join(v.select("globalid", "ts", F.col("local_id").alias("id"), "start_date", "end_date"), ["ts", "id"])
    f = row_numbers(f.withColumn("id", F.col("globalid")).drop("ord"), ["globalid"], "ord")
    f = f.withColumn("props", F.map_concat("props", F.create_map(F.lit("startDate"), F.col("start_date").cast("string"), F.lit("endDate"), F.col("end_date").cast("string"), F.lit("featureId"), F.col("globalid"))))
    ends = v.agg(F.min("start_date"), F.max("end_date")).first()
    # the document lists every transaction, so they pass the driver, a partition at a time
    tx = [r.asDict() for r in lineage.transactions(v, e).orderBy("start_date", "kind").toLocalIterator()]
    return finish(f, [], o, asset={"extensions": {"temporal": {"startDate": ends[0], "endDate": ends[1], "transactions": tx}}})


def ifc(spark: SparkSession, objects: DataFrame, o: Options, ancestors: DataFrame | None = None) -> dict:
    """objects(object_id, guid, classe, ifc_group, ifc_space, object_name, properties, tri or vertices and faces): a group of tiles by type, group or space.

    A space is a member of its own group. ancestors: see ifc_model.ancestors; with --with_BTH each tile has their hierarchy.
    """
    f = objects if "tri" in objects.columns else ifc_model.with_geometry(objects)
    key = ifc_model.group_key(f, o.grouped_by)
    names = {"classe": "classe", "group": "ifc_group", "space": "ifc_space", "name": "object_name", "properties": "properties"}
    props = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c))])
    f = f.select(F.col("object_id").alias("ord"), F.col("object_id").alias("database_id"), F.col("guid").alias("id"), "tri", props.alias("props"), key.alias("group_key"), *(["rgba"] if "rgba" in f.columns else []))
    return finish(f, [], o, group="group_key", instances=ancestors if o.with_BTH else None)


def reader(spark: SparkSession, folders: list[str], o: Options) -> dict:
    """Tilesets read back, merged, transformed and written again, tile by tile, each below the one it was below."""
    t = files.tilesets(spark, folders)
    f = tiles.read_tiles(spark, t)
    f = stored(f.withColumn("key", F.concat_ws("/", F.lpad(F.col("tileset_id").cast("string"), 9, "0"), "node_path")))
    f = row_numbers(f, ["key", "batch_id"], "ord").withColumn("props", F.when(F.size("props") > 0, F.col("props")))
    palette = [{"rgba": [1.0, 1.0, 1.0, 1.0], "metallic": 0.0, "roughness": 1.0, "double_sided": True}]
    images = files.pictures(spark, f) if o.with_texture else None
    return finish(f, palette, o, group="key", tree=tiles.read_tree(t, o.geometric_error), images=images)


def merger(folders: list[str], out: str) -> dict:
    """Tilesets put below one root; contents are copied under new names and not decoded."""
    docs = []
    os.makedirs(f"{out}/tiles", exist_ok=True)
    n = 0
    for folder in [f for f in folders if os.path.isdir(f)]:
        d = json.loads(Path(folder, "tileset.json").read_text())
        todo = list(d.get("root", {}).get("children", []))
        while todo:
            t = todo.pop()
            todo += t.get("children", [])
            uri = (t.get("content") or {}).get("uri") or (t.get("content") or {}).get("url")
            if uri and os.path.exists(f"{folder}/{uri}"):
                name = f"tiles/{n}{Path(uri).suffix}"
                data = Path(folder, uri).read_bytes()
                # the pictures a tile names come along under new names
                for k, picture in enumerate(tile_codec.pictures(data)):
                    own = Path(folder, uri).parent / picture
                    if own.exists():
                        new = f"{own.stem}_{n}_{k}{own.suffix}"
                        shutil.copyfile(own, f"{out}/tiles/{new}")
                        data = tile_codec.renamed(data, picture, new)
                Path(out, name).write_bytes(data)
                t["content"] = {"uri": name}
                n += 1
        docs.append(d)
    merged = tiles.merge_tilesets(docs)
    Path(out, "tileset.json").write_text(json.dumps(merged))
    return merged
