"""Building-information objects from tables: geometry by indexed faces, property sets, spaces and the chain of ancestors.

Nulls: objects without vertices or faces have no geometry; a face that names a missing vertex is left out; a null parent
ends a chain. Repeated rows of a link must be resolved before. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.operators import hierarchy


def with_geometry(objects: DataFrame) -> DataFrame:
    """objects(vertices array<struct<x,y,z>>, faces array<array<int>>[, diffuse array<double>]) with 'tri', and rgba of the first material, opaque."""
    at = lambda f, k: F.get("vertices", F.get(f, F.lit(k)))
    tri = F.transform("faces", lambda f: F.struct(at(f, 0).alias("a"), at(f, 1).alias("b"), at(f, 2).alias("c")))
    whole = F.filter(tri, lambda t: t["a"].isNotNull() & t["b"].isNotNull() & t["c"].isNotNull())
    out = objects.withColumn("tri", F.coalesce(G.map_points(whole, lambda p: G.point(p["x"], p["y"], p["z"])), F.array().cast(G.TRIANGLES)))
    if "diffuse" in objects.columns:
        out = out.withColumn("rgba", F.when(F.size("diffuse") >= 3, F.concat(F.slice("diffuse", 1, 3), F.array(F.lit(1.0)))))
    return out.drop("vertices", "faces", "diffuse")


def space_of(objects: DataFrame) -> Column:
    """The space an object stands in; a space stands in itself. With a column container_class other containers than spaces count as none."""
    own = F.col("ifc_space")
    if "container_class" in objects.columns:
        own = F.when(F.col("container_class") == "IfcSpace", own)
    return F.when(F.col("classe") == "IfcSpace", F.coalesce(F.col("object_name"), F.col("guid"))).otherwise(own)


#: How objects can be grouped, and the column each way takes.
GROUPS = {"IfcTypeObject": "classe", "IfcGroup": "ifc_group", "IfcSpace": "ifc_space"}


def group_key(objects: DataFrame, grouped_by: str) -> Column:
    """The group of an object by type, group or space; objects without one are the group None."""
    return F.coalesce(space_of(objects) if grouped_by == "IfcSpace" else F.col(GROUPS[grouped_by]), F.lit("None"))


def property_sets(rows: DataFrame) -> DataFrame:
    """rows(guid, pset_name, prop_name, prop_value, row_no) to (guid, properties): [[set, [name, value], ...], ...] as JSON, sets and properties in order of their first row.

    Combined set by set first, so an object with very many rows is a row a set.
    """
    r = rows.filter("guid is not null and prop_name is not null")
    pair = lambda *x: F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null")) for c in x]), F.lit("]"))
    one = r.select("guid", "pset_name", "row_no", pair(F.col("prop_name"), F.col("prop_value")).alias("p"))
    name = F.to_json(F.array("pset_name"))
    sets = one.groupBy("guid", "pset_name").agg(F.min("row_no").alias("first"), F.array_sort(F.collect_list(F.struct("row_no", "p"))).alias("own"))
    text = F.concat(F.lit("["), F.when(F.col("pset_name").isNull(), F.lit("null")).otherwise(name.substr(F.lit(2), F.length(name) - 2)), F.lit(","), F.array_join(F.transform("own", lambda x: x["p"]), ","), F.lit("]"))
    all_ = sets.select("guid", "first", text.alias("s")).groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("first", "s"))).alias("own"))
    return all_.select("guid", F.concat(F.lit("["), F.array_join(F.transform("own", lambda x: x["s"]), ","), F.lit("]")).alias("properties"))


def parents(container: DataFrame, decomposes: DataFrame, voids: DataFrame) -> DataFrame:
    """(id, parent) of three tables (id, parent): an object's container, else what it fills, else what it is part of; of several the smallest."""
    t = None
    for k, df in enumerate((container, voids, decomposes)):
        own = df.filter("id is not null and parent is not null").select("id", F.struct(F.lit(k).alias("k"), F.col("parent").cast("bigint").alias("parent")).alias("p"))
        t = own if t is None else t.unionByName(own)
    return t.groupBy("id").agg(F.min("p").alias("p")).select("id", F.col("p.parent").alias("parent"))


def ancestor_chain(links: DataFrame) -> DataFrame:
    """links(id, parent) to (id, step, ancestor_id): every ancestor from the next one up; chains that close have none."""
    r = hierarchy.resolve(links, paths=True).filter("fault is null or fault = 'orphan'")
    up = hierarchy.closure(r).filter("distance > 0")
    return up.select(F.col("node_id").alias("id"), F.col("distance").cast("int").alias("step"), "ancestor_id")
