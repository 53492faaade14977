"""Groups of features into tiles: zones, grid cells, palettes, levels of detail, numbering and transforms.

Nulls: a null group or cell is a group of its own. Order columns decide every tie, so results don't depend on
partitions. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.functions import geometry as G
from geostrata.operators import near
from geostrata.runtime import bounded, row_numbers

#: Geometric errors of leaves, extruded footprints, zones and the tileset (fixed values).
LEAF_ERROR, LOD1_ERROR, LOA_ERROR, ROOT_ERROR = 1.0, 5.0, 20.0, 500.0


def zones_first_match(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points(feature_id, x, y metres) with zone_id: the first zone in order that the point lies strictly inside, else null."""
    whole = lambda c: F.round(F.col(c) * near.UNIT).cast("bigint").alias(c)
    hits = near.containing_zones(points.select("feature_id", whole("x"), whole("y")), zones)
    first = hits.groupBy("feature_id").agg(F.min("zone_id").alias("zone_id"))
    return points.join(first, "feature_id", "left")


def grid_merge(groups: DataFrame, size: float = 1000.0) -> DataFrame:
    """groups(group_id, x, y, z): the first group of each rounded cell takes its members in (merged_id)."""
    cell = [G.grid_cell(F.col(k), size).alias("cell_" + k) for k in G.AXES]
    g = groups.select("group_id", *cell)
    first = g.groupBy("cell_x", "cell_y", "cell_z").agg(F.min("group_id").alias("merged_id"))
    return g.join(first, ["cell_x", "cell_y", "cell_z"])


def compact_palette(features: DataFrame, group: str, material: str, order: str) -> DataFrame:
    """Per group the materials in use, numbered from 0 by first use: (group, material, new_index)."""
    first = features.groupBy(group, material).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_first", material)) - 1
    return first.select(group, material, place.alias("new_index"))


def lod_nodes(groups: DataFrame, texture_lods: int = 0, lod1: bool = False, loa: bool = False, leaf_error: float = LEAF_ERROR, lod1_error: float = LOD1_ERROR, loa_error: float = LOA_ERROR) -> DataFrame:
    """groups(group_id) to their chains of nodes from the root down: (group_id, depth, kind, geometric_error, downsample).

    Below zones and extruded footprints come textured copies, coarsest first (down-sampled by 3, 13, 23, ...), then the leaf.
    """
    chain = [("loa", loa_error, 1)] * loa + [("lod1", lod1_error, 1)] * lod1
    chain += [("texture_lod", d / 3 + leaf_error, d) for d in range(3 + 10 * (texture_lods - 1), 2, -10)] if texture_lods > 0 else []
    chain += [("leaf", leaf_error, 1)]
    rows = F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(k).alias("kind"), F.lit(float(e)).alias("geometric_error"), F.lit(d).alias("downsample")) for i, (k, e, d) in enumerate(chain)])
    return groups.select("group_id", F.explode(rows).alias("n")).select("group_id", "n.*")


def vertical_lods(groups: DataFrame, errors: tuple[float, ...] = ()) -> DataFrame:
    """groups(group_id) in order as one chain: each wraps the one before; (group_id, depth, parent_id, geometric_error).

    The chain is as long as there are model files, so one task orders it.
    """
    w = Window.orderBy("group_id")
    g = groups.select("group_id", (F.row_number().over(w) - 1).alias("k"), F.lead("group_id").over(w).alias("parent_id"))
    n = F.max("k").over(Window.partitionBy())
    error = F.coalesce(F.try_element_at(F.array(*[F.lit(float(e)) for e in errors]) if errors else F.array().cast("array<double>"), F.col("k") + 1), F.lit(LEAF_ERROR))
    return g.select("group_id", (n - F.col("k")).alias("depth"), "parent_id", error.alias("geometric_error"))


def number_tiles(nodes: DataFrame) -> DataFrame:
    """nodes(group_id, depth, ...) with tile_index in pre-order: chains one after the other, each from its root down.

    Group sizes are summed in order of the group, so no task orders all nodes but one row a group.
    """
    sizes = nodes.groupBy("group_id").agg(F.count("*").alias("n"))
    before = sizes.select("group_id", (F.sum("n").over(Window.orderBy("group_id")) - F.col("n")).alias("before"))
    return nodes.join(before, "group_id").withColumn("tile_index", F.col("before") + F.col("depth")).drop("before")


def tile_boxes(features: DataFrame, tile: str = "tile") -> DataFrame:
    """Union of the features' boxes by tile: features(tile, box)."""
    return features.groupBy(tile).agg(*[f(F.col("box")[k + n]).alias(k + n) for n, f in (("min", F.min), ("max", F.max)) for k in G.AXES], F.count("*").alias("n_features"))


def tile_centroids(features: DataFrame, tile: str = "tile") -> DataFrame:
    """Mean of the members' centers by tile."""
    c = G.center(F.col("box"))
    return features.groupBy(tile).agg(*[F.avg(c[k]).alias("c" + k) for k in G.AXES])


def tree_centroid(centroids: DataFrame) -> DataFrame:
    """Mean of the tiles' means: each tile weighs the same."""
    return centroids.agg(*[F.avg("c" + k).alias("c" + k) for k in G.AXES])


def node_transform(features: DataFrame, tile: str = "tile", height_mult: float = 1.0, scale: float = 1.0, offset: tuple[float, float, float] | str = (0.0, 0.0, 0.0)) -> DataFrame:
    """features(tile, tri) with 'tri' around its tile's own centroid and the tile's translation (tx, ty, tz).

    Heights are multiplied, then everything is scaled about the tree's centroid, then each tile is recentered; the
    translation is the centroid plus the offset, or nothing when the offset is 'centroid'.
    """
    f = features.withColumn("tri", G.multiply_height(F.col("tri"), F.lit(float(height_mult)))).withColumn("box", G.bbox(F.col("tri")))
    if scale != 1.0:
        middle = bounded(tree_centroid(tile_centroids(f, tile)).select(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).alias("_c")), 1)
        f = f.crossJoin(middle).withColumn("tri", G.scale_about(F.col("tri"), F.lit(float(scale)), F.col("_c"))).drop("_c").withColumn("box", G.bbox(F.col("tri")))
    c = tile_centroids(f, tile)
    f = f.join(c, tile).withColumn("tri", G.translate(F.col("tri"), -F.col("cx"), -F.col("cy"), -F.col("cz"))).drop("box")
    own = (0.0, 0.0, 0.0) if offset == "centroid" else offset
    moved = [F.lit(0.0) if offset == "centroid" else F.col("c" + k) + F.lit(float(o)) for k, o in zip(G.AXES, own, strict=True)]
    return f.withColumns(dict(zip(("tx", "ty", "tz"), moved, strict=True))).drop("cx", "cy", "cz")


def matrix(tx: Column, ty: Column, tz: Column) -> Column:
    """4 x 4 translation, column by column, as tiles carry it."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, zero, zero, zero, one, zero, zero, zero, zero, one, zero, tx, ty, tz, one)


def keep_ids(features: DataFrame, ids: list[str] | DataFrame, column: str = "id", exclude: bool = False) -> DataFrame:
    """Features whose id is (or isn't) listed. A listed null matches nothing; excluding keeps rows with a null id."""
    listed = ids if isinstance(ids, DataFrame) else features.sparkSession.createDataFrame([(str(i),) for i in ids if i is not None] or [], "id string")
    listed = listed.select(F.col(listed.columns[0]).alias("_id")).distinct()
    return features.join(bounded(listed), F.col(column).cast("string") == F.col("_id"), "left_anti" if exclude else "left_semi")


def batch_table(features: DataFrame, tile: str, properties: str, order: str) -> DataFrame:
    """(tile, key, values): the properties' values of a tile's features in order, null where missing; keys by first use.

    A tile gets a table only if each of its features has properties. Tiles are bounded by the kd-tree's maximum.
    """
    whole = features.groupBy(tile).agg(F.min((F.coalesce(F.size(properties), F.lit(0)) > 0).cast("int")).alias("_all"), F.count("*").alias("_n"))
    f = features.join(whole.filter("_all = 1").select(tile), tile)
    f = f.withColumn("_at", F.row_number().over(Window.partitionBy(tile).orderBy(order)) - 1)
    keys = f.select(tile, "_at", F.posexplode(F.map_keys(properties)).alias("_k", "key")).groupBy(tile, "key").agg(F.min(F.struct("_at", "_k")).alias("first_use"))
    cells = f.join(keys, tile).select(tile, "key", "first_use", "_at", F.col(properties)[F.col("key")].alias("v"))
    return cells.groupBy(tile, "key", "first_use").agg(F.sort_array(F.collect_list(F.struct("_at", "v"))).alias("c")).select(tile, "key", F.row_number().over(Window.partitionBy(tile).orderBy("first_use")).alias("key_no"), F.transform("c", lambda x: x["v"]).alias("values"))


def vertex_index(vertices: DataFrame, order: str = "ord", keys: tuple[str, ...] = ("x", "y", "z"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Equal vertices are one; numbered from 1 in order of first occurrence: (x, y, z, vertex_no[, carry of the first occurrence])."""
    first = vertices.groupBy(*keys).agg(F.min(order).alias("_first"), *[F.min_by(c, order).alias(c) for c in carry])
    return row_numbers(first, ["_first"], "_no").select(*keys, *carry, (F.col("_no") + 1).alias("vertex_no"))
