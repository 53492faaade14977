"""City-model queries over relational tables, set by set: no query per object.

Tables are DataFrames with the columns of the relational city schema. All joins are equi-joins and left to the
planner (AQE splits skewed keys). Null keys match nothing. Repeated rows of a dimension repeat matches, as in SQL.
Surfaces of an object are collected into one array, so an object's geometry must fit a row, as it must in a tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.runtime import row_numbers


def objects(own: DataFrame, cityobject: DataFrame, root: str | None = None, gmlids: list[str] | None = None) -> DataFrame:
    """(id, gmlid) of buildings, bridges, terrain or water; root: the column that must equal id for a top object."""
    o = own.filter(F.col("id") == F.col(root)) if root else own
    c = cityobject.select("id", "gmlid")
    c = c.filter(F.col("gmlid").isin(gmlids)) if gmlids is not None else c
    return o.select("id").join(c, "id")


def building_surfaces(t: dict[str, DataFrame]) -> DataFrame:
    """surface_geometry with its thematic surface, building and both classes: (surface_id, building_id, building_class, surface_class, tri)."""
    oc = t["objectclass"]
    ts = t["thematic_surface"].select(F.col("lod2_multi_surface_id").alias("root_id"), F.col("building_id"), F.col("objectclass_id").alias("surface_class_id"))
    b = t["building"].select(F.col("id").alias("building_id"), "building_root_id", F.col("objectclass_id").alias("building_class_id"))
    return (
        t["surface_geometry"].select(F.col("id").alias("surface_id"), "root_id", "tri").filter("tri is not null").join(ts, "root_id").join(b, "building_id")
        .join(oc.select(F.col("id").alias("building_class_id"), F.col("classname").alias("building_class")), "building_class_id")
        .join(oc.select(F.col("id").alias("surface_class_id"), F.col("classname").alias("surface_class")), "surface_class_id", "left")
    )


def merged(surfaces: DataFrame, root: str, classname: str) -> DataFrame:
    """One geometry per object and class."""
    return surfaces.groupBy(F.col(root).alias("id"), F.col(classname).alias("classname")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("surface_id", "tri"))), lambda s: s["tri"])).alias("tri"))


def split(surfaces: DataFrame, classname: str) -> DataFrame:
    """One geometry per surface."""
    return surfaces.select(F.col("surface_id").alias("id"), F.col(classname).alias("classname"), "tri")


def relief_surfaces(t: dict[str, DataFrame]) -> DataFrame:
    """Through the m:n table of relief features and their components."""
    r = t["relief_feature"].select(F.col("id").alias("relief_feature_id"), "objectclass_id")
    tin = t["tin_relief"].select(F.col("id").alias("relief_component_id"), F.col("surface_geometry_id").alias("root_id"))
    oc = t["objectclass"].select(F.col("id").alias("objectclass_id"), "classname")
    return t["surface_geometry"].select(F.col("id").alias("surface_id"), "root_id", "tri").filter("tri is not null").join(tin, "root_id").join(t["relief_feat_to_rel_comp"], "relief_component_id").join(r, "relief_feature_id").join(oc, "objectclass_id")


def water_surfaces(t: dict[str, DataFrame]) -> DataFrame:
    """Through the m:n table of water bodies and their boundary surfaces, with both classes."""
    s = t["waterboundary_surface"].select(F.col("id").alias("waterboundary_surface_id"), F.col("lod3_surface_id").alias("root_id"), F.col("objectclass_id").alias("surface_class_id"))
    w = t["waterbody"].select(F.col("id").alias("waterbody_id"), F.col("objectclass_id").alias("body_class_id"))
    oc = t["objectclass"]
    return (
        t["surface_geometry"].select(F.col("id").alias("surface_id"), "root_id", "tri").filter("tri is not null").join(s, "root_id").join(t["waterbod_to_waterbnd_srf"], "waterboundary_surface_id").join(w, "waterbody_id")
        .join(oc.select(F.col("id").alias("body_class_id"), F.col("classname").alias("body_class")), "body_class_id")
        .join(oc.select(F.col("id").alias("surface_class_id"), F.col("classname").alias("surface_class")), "surface_class_id", "left")
    )


def bridge_surfaces(t: dict[str, DataFrame]) -> DataFrame:
    b = t["bridge"].select(F.col("id").alias("bridge_id"), "bridge_root_id", F.col("lod2_multi_surface_id").alias("root_id"), "objectclass_id")
    oc = t["objectclass"].select(F.col("id").alias("objectclass_id"), "classname")
    return t["surface_geometry"].select(F.col("id").alias("surface_id"), "root_id", "tri").filter("tri is not null").join(b, "root_id").join(oc, "objectclass_id")


def textured(surfaces: DataFrame, textureparam: DataFrame, surface_data: DataFrame, tex_image: DataFrame) -> DataFrame:
    """Surfaces with their texture: uv turned over (v to 1 - v) and the image's name."""
    p = textureparam.select(F.col("surface_geometry_id").alias("surface_id"), "surface_data_id", "uv")
    d = surface_data.select(F.col("id").alias("surface_data_id"), "tex_image_id")
    i = tex_image.select(F.col("id").alias("tex_image_id"), "tex_image_uri")
    turned = F.transform("uv", lambda t: F.struct(*[F.struct(t[k]["u"].alias("u"), (1 - t[k]["v"]).alias("v")).alias(k) for k in "abc"]))
    return surfaces.join(p, "surface_id").join(d, "surface_data_id").join(i, "tex_image_id").withColumn("uv", turned)


def texture_images(wanted: DataFrame, tex_image: DataFrame) -> DataFrame:
    """The image of each name once: (tex_image_uri, tex_image_data)."""
    own = tex_image.groupBy("tex_image_uri").agg(F.min_by("tex_image_data", "id").alias("tex_image_data"))
    return wanted.select("tex_image_uri").distinct().join(own, "tex_image_uri")


def _nearest(t, cx, cy) -> tuple:
    """(square of the distance in the plane, height) of the point of a triangle nearest to the upright line through (cx, cy)."""
    inside = []
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        inside.append((t[q]["x"] - t[p]["x"]) * (cy - t[p]["y"]) - (t[q]["y"] - t[p]["y"]) * (cx - t[p]["x"]))
    whole = inside[0] + inside[1] + inside[2]
    within = (whole != 0) & (((inside[0] >= 0) & (inside[1] >= 0) & (inside[2] >= 0)) | ((inside[0] <= 0) & (inside[1] <= 0) & (inside[2] <= 0)))
    height = (inside[1] * t["a"]["z"] + inside[2] * t["b"]["z"] + inside[0] * t["c"]["z"]) / F.when(whole != 0, whole)
    ends = []
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        dx, dy, dz = (t[q][k] - t[p][k] for k in G.AXES)
        size = dx * dx + dy * dy
        share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - t[p]["x"]) * dx + (cy - t[p]["y"]) * dy) / size))).otherwise(0.0)
        fx, fy = t[p]["x"] + share * dx - cx, t[p]["y"] + share * dy - cy
        ends.append(F.struct((fx * fx + fy * fy).alias("far"), (t[p]["z"] + share * dz).alias("z")))
    return F.when(within, F.struct(F.lit(0.0).alias("far"), height.alias("z"))).otherwise(F.least(*ends))


def centroids(surfaces: DataFrame, root: str) -> DataFrame:
    """(id, x, y, z): area-weighted middle in the plane, at the height of the geometry's point nearest to the upright line through it.

    Of points equally near (to a thousandth of a millimetre) the lowest counts. Objects without area take the mean of corners.
    """
    t = surfaces.select(F.col(root).alias("id"), F.explode("tri").alias("t"))
    third = lambda k: (F.col("t.a")[k] + F.col("t.b")[k] + F.col("t.c")[k]) / 3
    n = G.cross(F.col("t"))
    t = t.select("id", "t", *[third(k).alias(k) for k in "xy"], (F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"]) / 2).alias("area"))
    m = t.groupBy("id").agg(F.sum("area").alias("a"), *[F.sum(F.col(k) * F.col("area")).alias("s" + k) for k in "xy"], *[F.avg(k).alias("m" + k) for k in "xy"])
    m = m.select("id", *[F.when(F.col("a") > 0, F.col("s" + k) / F.col("a")).otherwise(F.col("m" + k)).alias("c" + k) for k in "xy"])
    near = t.join(m, "id").withColumn("n", _nearest(F.col("t"), F.col("cx"), F.col("cy")))
    return near.groupBy("id").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), F.min(F.struct(F.round(F.sqrt("n.far"), 6).alias("far"), F.col("n.z").alias("z")))["z"].alias("z"))


def hierarchy_surfaces(t: dict[str, DataFrame], root_ids: DataFrame | None = None) -> DataFrame:
    """(id, parent_id, gmlid, objectclass_id) of the surfaces of buildings and their parts that have a geometry, each once; root_ids: of these top buildings only."""
    b = _of_roots(t["building"], root_ids)
    g = t["surface_geometry"].filter("tri is not null").select(F.col("root_id").alias("lod2_multi_surface_id"))
    s = t["thematic_surface"].join(b.select(F.col("id").alias("building_id")), "building_id", "left_semi").join(g, "lod2_multi_surface_id", "left_semi")
    return s.select("id", F.col("building_id").alias("parent_id"), "objectclass_id").join(t["cityobject"].select("id", "gmlid"), "id").distinct()


def _of_roots(building: DataFrame, root_ids: DataFrame | None) -> DataFrame:
    return building if root_ids is None else building.join(root_ids.select(F.col("id").alias("building_root_id")).distinct(), "building_root_id", "left_semi")


def hierarchy_instances(building: DataFrame, cityobject: DataFrame, surfaces: DataFrame, objectclass: DataFrame, root_ids: DataFrame | None = None) -> DataFrame:
    """Surfaces (see hierarchy_surfaces) and building parts with their position: (position, id, parent_id, gmlid, classname); geometric instances first."""
    parts = _of_roots(building, root_ids).select("id", F.col("building_parent_id").alias("parent_id"), "objectclass_id").join(cityobject.select("id", "gmlid"), "id").withColumn("kind", F.lit(1))
    all_ = surfaces.withColumn("kind", F.lit(0)).unionByName(parts).join(objectclass.select(F.col("id").alias("objectclass_id"), "classname"), "objectclass_id", "left")
    return row_numbers(all_, ["kind", "id"], "position").select("position", "id", "parent_id", "gmlid", "classname")


def hierarchy_parents(instances: DataFrame) -> DataFrame:
    """(position, parent_position) of instances whose parent is one, too."""
    p = instances.select(F.col("id").alias("parent_id"), F.col("position").alias("parent_position"))
    return instances.select("position", "parent_id").join(p, "parent_id").select("position", "parent_position")


def class_materials(surfaces: DataFrame, classname: str, order: str) -> DataFrame:
    """(classname, material_index) of each class, numbered from 1 by first use in the order; 0 is the default material."""
    first = surfaces.filter(F.col(classname).isNotNull()).groupBy(F.col(classname).alias("classname")).agg(F.min(order).alias("first"))
    return row_numbers(first, ["first", "classname"], "no").select("classname", (F.col("no") + 1).cast("int").alias("material_index"))


def reattach(objects_: DataFrame, results: DataFrame) -> DataFrame:
    """Query results matched back to the objects by gmlid."""
    return objects_.join(results, "gmlid")
