"""From features to tilesets and back: level-of-detail geometry, tile content as B3DM rows, the tileset's JSON, meshes.

features: (ord, id, tri[, uv, material_index, props]). Rows without triangles are left out before partitioning.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.functions import geometry as G
from geostrata.functions import images, mesh, tile_codec
from geostrata.operators import atlas, grouping, kdtree, nested
from geostrata.runtime import row_numbers, stored

#: Features of a zone, cell or class that one tile takes; larger groups are several tiles.
GROUP_FEATURES = 20_000


def with_geometry(features: DataFrame) -> DataFrame:
    return features.filter("size(tri) > 0")


def partitioned(features: DataFrame, zones: DataFrame | None = None, as_lods: bool = False, group: str | None = None, most: int = kdtree.DEFAULT_MAX, whole: bool = False) -> DataFrame:
    """Adds 'tile' from 0: by a group column, by zones and grid cells, by feature, or by kd-tree, in that order of precedence.

    With zones also 'head': the tile that holds the blocks of the tile's zones. Where a group is dealt out over several
    tiles, members of zones and other features never share one, so that the blocks stand for whole tiles. whole: no group is dealt out.
    """
    f = with_geometry(features)
    c = G.center(G.bbox(F.col("tri")))
    if group:
        key = F.col(group)
    elif zones is not None:
        p = f.select(F.col("ord").alias("feature_id"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"))
        z = grouping.zones_first_match(p, zones)
        own = F.coalesce(F.concat(F.lit("z"), F.lpad(F.col("zone_id").cast("string"), 20, "0")), F.concat(F.lit("~"), F.lpad(F.col("feature_id").cast("string"), 20, "0")))
        z = z.withColumn("group_id", own)
        middle = z.groupBy("group_id").agg(*[F.avg(k).alias(k) for k in G.AXES])
        merged = grouping.grid_merge(middle).select("group_id", "merged_id")
        f = f.join(z.join(merged, "group_id").select(F.col("feature_id").alias("ord"), "merged_id", "zone_id"), "ord")
        key = F.col("merged_id")
    elif as_lods:
        key = F.col("ord")
    else:
        slim = f.select("ord", c["x"].alias("x"), c["y"].alias("y"))
        return f.join(kdtree.numbered(kdtree.cells(slim, most)).select("ord", F.col("tile").cast("int").alias("tile")), "ord")
    # groups of any size: more than a task should hold are dealt out over several tiles
    zoned = not group and zones is not None
    f = f.withColumn("key", key).withColumn("member", F.col("zone_id").isNotNull() if zoned else F.lit(False))
    sides = f.groupBy("key", "member").count().withColumn("all", F.sum("count").over(Window.partitionBy("key")))
    large = sides.filter((F.col("all") > GROUP_FEATURES) & ~F.lit(whole)).select(F.col("key").alias("own"), F.col("member").alias("own_member"), (F.floor(F.col("count") / GROUP_FEATURES) + 1).alias("shares"))
    f = f.join(large, F.col("key").eqNullSafe(F.col("own")) & (F.col("member") == F.col("own_member")), "left")
    f = f.withColumn("share", F.pmod(F.xxhash64("ord"), F.coalesce("shares", F.lit(1)))).withColumn("member", F.col("member") & F.col("shares").isNotNull()).drop("own", "own_member", "shares")
    first = f.groupBy("key", "member", "share").agg(F.min("ord").alias("first"))
    numbers = row_numbers(first, ["first"], "tile").select(F.col("key").alias("own"), F.col("member").alias("own_member"), F.col("share").alias("own_share"), F.col("tile").cast("int").alias("tile"))
    if zoned:
        numbers = numbers.withColumn("head", F.when(F.col("own_member"), F.min("tile").over(Window.partitionBy("own", "own_member"))).otherwise(F.col("tile")))
    same = F.col("key").eqNullSafe(F.col("own")) & (F.col("member") == F.col("own_member")) & (F.col("share") == F.col("own_share"))
    return f.join(numbers, same).drop("key", "own", "member", "own_member", "share", "own_share", "merged_id")


def lod1(features: DataFrame) -> DataFrame:
    """Each feature's footprint hull from its lowest point to the mean of its triangles' tops."""
    f = features.select("tile", "ord", mesh.hull_block(G.corners(F.col("tri")), G.min_z(F.col("tri")), G.mean_max_z(F.col("tri"))).alias("tri"))
    return f.select("tile", "ord", F.concat(F.lit("lod1_"), F.col("ord").cast("string")).alias("id"), "tri")


def loa(features: DataFrame, zones: DataFrame) -> DataFrame:
    """Each zone with members over the height range of all of them, in the tile 'head'; features in no zone by their own hull."""
    f = features.select("tile", "head", "ord", "zone_id", G.min_z(F.col("tri")).alias("low"), G.mean_max_z(F.col("tri")).alias("high"), F.size("tri").alias("n"), G.corners(F.col("tri")).alias("p"))
    # the mean over all triangles of all members: features weigh by their triangles
    z = f.filter("zone_id is not null").groupBy(F.col("head").alias("tile"), "zone_id").agg(F.min("low").alias("low"), (F.sum(F.col("high") * F.col("n")) / F.sum("n")).alias("high"))
    z = z.join(zones.select("zone_id", "ring"), "zone_id").select("tile", F.col("zone_id").alias("ord"), mesh.outline_block("ring", "low", "high").alias("tri"))
    rest = f.filter("zone_id is null").select("tile", "ord", mesh.hull_block("p", "low", "high").alias("tri"))
    return z.unionByName(rest).select("tile", "ord", F.concat(F.lit("loa_"), F.col("ord").cast("string")).alias("id"), "tri")


CONTENT = "tile int, n_features int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, tx double, ty double, tz double, atlas binary, b3dm binary"
#: Side table of tiles: images (kind image, named by uri) and batch table extensions (kind extension, JSON).
EXTRAS = "tile int, kind string, name string, data binary"


def tile_images(features: DataFrame, images: DataFrame) -> DataFrame:
    """images(texture, data) that a tile's features name, once a tile (see EXTRAS)."""
    wanted = features.filter("texture is not null").select("tile", "texture").distinct()
    return wanted.join(images, "texture").select("tile", F.lit("image").alias("kind"), F.col("texture").alias("name"), "data")


def tile_hierarchies(instances: DataFrame) -> DataFrame:
    """instances(tile, kind, id, parent_id, gmlid, classname) to the hierarchy extension of each tile (see EXTRAS). A tile's instances are bounded by its features."""

    def build(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["kind", "id"])
        rows = [(i, None if pd.isna(p) else int(p), c or "", {"gmlid": g}) for i, p, c, g in zip(t["id"], t["parent_id"], t["classname"], t["gmlid"], strict=True)]
        return pd.DataFrame([(int(t["tile"].iloc[0]), "extension", "3DTILES_batch_table_hierarchy", json.dumps(tile_codec.hierarchy(rows)).encode())], columns=["tile", "kind", "name", "data"])

    return instances.groupBy("tile").applyInPandas(build, EXTRAS)


def _atlas(t: pd.DataFrame, extras: pd.DataFrame | None, downsample: int, level: int) -> tuple[list[np.ndarray], bytes] | None:
    """Texture coordinates by feature on one sheet and the sheet's file; None unless every feature has coordinates and a readable image."""
    if extras is None or "texture" not in t or any(u is None for u in t["uv"]) or any(x is None for x in t["texture"]):
        return None
    pictures = {n: images.decode_png(d) for k, n, d in zip(extras["kind"], extras["name"], extras["data"], strict=True) if k == "image"}  # each image once
    if any(pictures.get(x) is None for x in t["texture"]):
        return None
    flat = [np.array([[q["u"], q["v"]] for x in uv for q in (x["a"], x["b"], x["c"])]) for uv in t["uv"]]
    parts = [images.cropped(pictures[x], uv) for x, uv in zip(t["texture"], flat, strict=True)]
    places, w, h = atlas.pack([(p.shape[1], p.shape[0]) for p, _ in parts])
    moved = [uv * [p.shape[1] / w, p.shape[0] / h] + [left / w, top / h] for (p, uv), (left, top) in zip(parts, places, strict=True)]
    sheet = images.sheet([p for p, _ in parts], places, w, h)
    return moved, images.encode_png(images.smaller(sheet, downsample) if downsample > 1 else sheet, level)


def contents(features: DataFrame, materials: list[dict], with_normals: bool = True, offset: tuple[float, float, float] | str = (0.0, 0.0, 0.0), extras: DataFrame | None = None, downsample: int = 1, layer: tuple[int, int] = (1, 0), level: int = 6) -> DataFrame:
    """One row a tile with its B3DM content, box around its own center, and translation. A tile is bounded by its group, so one task builds it.

    Batch ids are the features' places by 'ord'; triangles are grouped by material in order of first use: by material_index, or by
    a column rgba of the features' own. extras: see EXTRAS; a tile whose features all have images gets one sheet of them.
    layer: number of layers and this one's, which number the sheets.
    """
    have = [c for c in ("uv", "colors", "material_index", "rgba", "texture", "props") if c in features.columns]
    slim = features.select("tile", "ord", F.col("id").cast("string").alias("id"), "tri", *have)
    palette = materials or [tile_codec.DEFAULT_MATERIAL]
    centered = offset == "centroid"
    shift = np.zeros(3) if centered else np.array(offset, float)

    def corners(t) -> np.ndarray:
        return np.array([[[q["x"], q["y"], q["z"]] for q in (x["a"], x["b"], x["c"])] for x in t], float).reshape(-1, 3, 3)

    def build(t: pd.DataFrame, side: pd.DataFrame | None = None) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in CONTENT.split(", ")])
        t = t.sort_values("ord", ignore_index=True)
        tile = int(t["tile"][0])
        tris = [corners(x) for x in t["tri"]]
        mids = np.array([(x.reshape(-1, 3).min(0) + x.reshape(-1, 3).max(0)) / 2 for x in tris])
        center = mids.mean(0)
        drawn = _atlas(t, side, downsample, level)
        if drawn:
            used = [None] * len(t)
            own = {None: palette[0] | {"texture": f"ATLAS_{tile * layer[0] + layer[1]}.png"}}
        elif "rgba" in t:
            used = [None if x is None else tuple(x) for x in t["rgba"]]
            own = {x: palette[0] if x is None else palette[0] | {"rgba": list(x)} for x in dict.fromkeys(used)}
        else:
            used = t["material_index"].fillna(0).astype(int).tolist() if "material_index" in t else [0] * len(t)
            own = {m: palette[m] if m < len(palette) else palette[0] for m in dict.fromkeys(used)}
        primitives = []
        for k, m in enumerate(own):
            rows = [i for i, u in enumerate(used) if u == m]
            tri = np.concatenate([tris[i] for i in rows]) - center
            p = {"positions": tri.reshape(-1, 3), "batch_ids": np.repeat(rows, [len(tris[i]) * 3 for i in rows]), "material": k}
            if with_normals:
                p["normals"] = tile_codec.normals(tri)
            if drawn:
                p["uvs"] = np.concatenate([drawn[0][i] for i in rows])
            elif "uv" in t and all(t["uv"][i] is not None for i in rows):
                p["uvs"] = np.array([[q["u"], q["v"]] for i in rows for x in t["uv"][i] for q in (x["a"], x["b"], x["c"])])
            if "colors" in t and all(t["colors"][i] is not None for i in rows):
                p["colors"] = np.array([[q["r"], q["g"], q["b"]] for i in rows for x in t["colors"][i] for q in (x["a"], x["b"], x["c"])])
            primitives.append(p)
        table: dict = {"id": t["id"].tolist()}
        if "props" in t and all(x for x in t["props"]):
            props = [dict(x) for x in t["props"]]
            table |= {k: [x.get(k) for x in props] for k in dict.fromkeys(k for x in props for k in x)}
        if side is not None and (side["kind"] == "extension").any():
            table["extensions"] = {n: json.loads(d) for k, n, d in zip(side["kind"], side["name"], side["data"], strict=True) if k == "extension"}
        glb = tile_codec.encode_glb(primitives, list(own.values()))
        every = np.concatenate(tris).reshape(-1, 3) - center
        low, high = every.min(0), every.max(0)
        move = np.zeros(3) if centered else center + shift
        return pd.DataFrame([(tile, len(t), *low, *high, *move, drawn[1] if drawn else None, tile_codec.encode_b3dm(glb, len(t), table))], columns=[c.split()[0] for c in CONTENT.split(", ")])

    if extras is None:
        return slim.groupBy("tile").applyInPandas(lambda t: build(t), CONTENT)
    return slim.groupBy("tile").cogroup(extras.groupBy("tile")).applyInPandas(lambda t, side: build(t, side), CONTENT)


def tileset_json(rows: list[dict], asset: dict | None = None) -> dict:
    """The tileset of tile rows(tile, parent, geometric_error[, refine], box..., translation, uri or None): roots below one root that holds them all. Translations become relative to the parent's."""

    def box(r: dict, moved: bool) -> list[float]:
        t = [r["tx"], r["ty"], r["tz"]] if moved else [0, 0, 0]
        c = [(r[k + "min"] + r[k + "max"]) / 2 + t[i] for i, k in enumerate(G.AXES)]
        h = [(r[k + "max"] - r[k + "min"]) / 2 for k in G.AXES]
        return [*c, h[0], 0, 0, 0, h[1], 0, 0, 0, h[2]]

    nodes, by_tile = {}, {r["tile"]: r for r in rows}
    for r in rows:
        above = by_tile[r["parent"]] if r.get("parent") is not None else {"tx": 0, "ty": 0, "tz": 0}
        m = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *(r["t" + k] - above["t" + k] for k in G.AXES), 1]
        nodes[r["tile"]] = {"boundingVolume": {"box": box(r, False)}, "geometricError": r["geometric_error"], "refine": r.get("refine") or "REPLACE", "transform": m, **({"content": {"uri": r["uri"]}} if r["uri"] else {}), "children": []}
    roots = []
    for r in rows:
        (nodes[r["parent"]]["children"] if r.get("parent") is not None else roots).append(nodes[r["tile"]])
    tops = [r for r in rows if r.get("parent") is None]
    if tops:
        low = [min(r[k + "min"] + r["t" + k] for r in tops) for k in G.AXES]
        high = [max(r[k + "max"] + r["t" + k] for r in tops) for k in G.AXES]
        whole = [*[(a + b) / 2 for a, b in zip(low, high, strict=True)], (high[0] - low[0]) / 2, 0, 0, 0, (high[1] - low[1]) / 2, 0, 0, 0, (high[2] - low[2]) / 2]
    else:
        whole = [0] * 12
    root = {"boundingVolume": {"box": whole}, "geometricError": grouping.ROOT_ERROR, "refine": "ADD", "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "children": roots}
    return {"asset": {"version": "1.0", **(asset or {})}, "geometricError": grouping.ROOT_ERROR, "root": root}


#: Tiles that one document names; a larger tileset is a tree of documents.
DOCUMENT_TILES = 20_000


def write_tileset(layers: list[tuple[DataFrame, float]], folder: str, asset: dict | None = None, heads: dict[int, int] | None = None, tree: dict[tuple, dict] | None = None, chain: tuple[float, ...] | None = None) -> dict:
    """Writes tiles/<n>.b3dm, the tiles' sheets and tileset.json. layers: tile contents with their geometric error, from the coarsest down; tiles of equal number are one chain.

    heads: tiles whose coarsest content is that of another tile, below which they go. tree: see linked(). chain: each tile
    goes below the one after it, with errors by place.

    Tile files are written by the executors into the shared folder under names that only depend on the tile, so a task that runs
    twice writes the same. The driver gets slim rows; beyond DOCUMENT_TILES neighbouring tiles become documents of their own,
    written by the executors, too, and the driver gets a row for each.
    """
    os.makedirs(f"{folder}/tiles", exist_ok=True)
    n = len(layers)

    def save(k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def put(path: str, data: bytes) -> None:
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.{os.getpid()}", path)

            for t in batches:
                for tile, data, picture in zip(t["tile"], t["b3dm"], t["atlas"], strict=True):
                    if picture is not None:
                        put(f"{folder}/tiles/ATLAS_{tile * n + k}.png", picture)
                    put(f"{folder}/tiles/{tile * n + k}.b3dm", data)
                yield t.drop(columns=["b3dm", "atlas"])

        return run

    slim_schema = CONTENT.rpartition(", atlas")[0]
    slim = None
    for k, (content, error) in enumerate(layers):
        own = content.mapInPandas(save(k), slim_schema).select("*", F.lit(k).alias("layer"), F.lit(float(error)).alias("error"))
        slim = own if slim is None else slim.unionByName(own)
    slim = stored(slim)

    def named(d: dict) -> dict:
        k = d.pop("layer")
        above = (heads or {}).get(d["tile"], d["tile"]) if k == 1 else d["tile"]
        return d | {"tile": d["tile"] * n + k, "parent": None if k == 0 else above * n + k - 1, "geometric_error": d.pop("error"), "uri": f"tiles/{d['tile'] * n + k}.b3dm"}

    plain = not heads and tree is None and chain is None
    if plain and slim.count() > DOCUMENT_TILES:
        block = max(1, DOCUMENT_TILES // n)
        columns = "tile int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double, geometric_error double"

        def document(t: pd.DataFrame) -> pd.DataFrame:
            rows = _rooted([named(d) for d in t.sort_values(["tile", "layer"]).drop(columns="block").to_dict("records")])
            for r in rows:
                r["uri"] = "../" + r["uri"]
            doc, no = tileset_json(rows, asset), int(t["tile"].min()) // block
            os.makedirs(f"{folder}/tilesets", exist_ok=True)
            path = f"{folder}/tilesets/{no}.json"
            with open(f"{path}.{os.getpid()}", "w") as f:
                json.dump(doc, f)
            os.replace(f"{path}.{os.getpid()}", path)
            box = doc["root"]["boundingVolume"]["box"]
            half = [box[3], box[7], box[11]]
            return pd.DataFrame([(no, *(c - h for c, h in zip(box, half, strict=False)), *(c + h for c, h in zip(box, half, strict=False)), doc["root"]["geometricError"])], columns=[c.split()[0] for c in columns.split(", ")])

        docs = slim.withColumn("block", F.expr(f"tile div {block}")).groupBy("block").applyInPandas(document, columns)
        rows = [r.asDict() | {"tx": 0.0, "ty": 0.0, "tz": 0.0, "parent": None, "uri": f"tilesets/{r.tile}.json"} for r in docs.toLocalIterator()]
    else:
        rows = _rooted([named(r.asDict()) for r in slim.orderBy("layer", "tile").toLocalIterator()])
        if tree is not None:
            rows = linked(rows, tree, n)
        if chain is not None:
            order = sorted(rows, key=lambda r: r["tile"])
            for i, r in enumerate(order):
                r["parent"] = order[i + 1]["tile"] if i + 1 < len(order) else None
                r["geometric_error"] = chain[i] if i < len(chain) and chain[i] is not None else grouping.LEAF_ERROR
    out = tileset_json(sorted(rows, key=lambda r: r["tile"]), asset)
    with open(f"{folder}/tileset.json", "w") as f:
        json.dump(out, f)
    return out


def _rooted(rows: list[dict]) -> list[dict]:
    """A tile without a coarser one is a root itself."""
    known = {r["tile"] for r in rows}
    for r in rows:
        if r["parent"] is not None and r["parent"] not in known:
            r["parent"] = None
    return rows


def linked(rows: list[dict], tree: dict[tuple, dict], n: int) -> list[dict]:
    """Tile rows below each other as their nodes are: tree has (tileset, steps of the path) to (geometric_error, refine[, tile]).

    Nodes without a tile that stand above some tile stay, with the box of what is below them; but for a root without one.
    n: layers a tile has; the coarsest goes below the parent's finest.
    """
    by_tile = {r["tile"]: r for r in rows}
    finest = {t: max((t * n + k for k in range(n) if t * n + k in by_tile), default=None) for t in {r["tile"] // n for r in rows}}
    new, numbers = max(by_tile, default=0) + 1, {}
    low = {}
    for at in sorted(tree, key=lambda x: (-len(x[1]), x)):  # from the deepest up
        v = tree[at]
        own = finest.get(v.get("tile"))
        if own is None:
            if at not in low or len(at[1]) == 1:
                continue
            numbers[at], own, new = (new, new), new, new + 1
            by_tile[own] = {"tile": own, "tx": 0.0, "ty": 0.0, "tz": 0.0, "uri": None, "parent": None} | low[at]
        else:
            numbers[at] = (min(v["tile"] * n + k for k in range(n) if v["tile"] * n + k in by_tile), own)
        by_tile[own] |= {"geometric_error": v["geometric_error"], "refine": v["refine"]}
        box = [{f"{k}{m}": by_tile[x][f"{k}{m}"] + by_tile[x]["t" + k] for k in G.AXES for m in ("min", "max")} for x in numbers[at]]
        for b in [*box, *([low[at]] if at in low else [])]:
            for i in range(1, len(at[1])):
                up = low.setdefault((at[0], at[1][:i]), dict(b))
                up |= {c: (min if c.endswith("min") else max)(up[c], b[c]) for c in b}
    for at, (top, _) in numbers.items():
        above = next((numbers[at[0], at[1][:i]][1] for i in range(len(at[1]) - 1, 0, -1) if (at[0], at[1][:i]) in numbers), None)
        by_tile[top]["parent"] = above
    return list(by_tile.values())


def read_tree(tilesets: DataFrame, errors: tuple[float | None, ...] = ()) -> dict[tuple, dict]:
    """(tileset_id, steps of the path) of every tile to its geometric error and refinement, which is the parent's where a tile has none.

    errors: by height above the leaves instead of the tiles' own, the last one for all higher tiles; None keeps the own.
    The driver gets a slim row a tile, as for writing.
    """
    cols = nested.tile_columns(tilesets)
    t = nested.tiles(cols).select("record_id", "node_path", F.col("geometric_error").try_cast("double").alias("geometric_error"), F.upper("refine").alias("refine"))
    tree = {(r.record_id, tuple(map(int, r.node_path.split(".")))): {"geometric_error": r.geometric_error, "refine": r.refine, "height": 0} for r in t.toLocalIterator()}
    for at in sorted(tree, key=lambda x: -len(x[1])):
        above = tree.get((at[0], at[1][:-1]))
        if above:
            above["height"] = max(above["height"], tree[at]["height"] + 1)
    for at in sorted(tree, key=lambda x: len(x[1])):
        v, above = tree[at], tree.get((at[0], at[1][:-1]), {})
        own = errors[min(v["height"], len(errors) - 1)] if errors else None
        v["geometric_error"] = own if own is not None else grouping.LEAF_ERROR if v["geometric_error"] is None else v["geometric_error"]
        v["refine"] = v["refine"] or above.get("refine") or "REPLACE"
    return tree


UVS = "array<struct<a:struct<u:double,v:double>,b:struct<u:double,v:double>,c:struct<u:double,v:double>>>"
COLORS = "array<struct<a:struct<r:double,g:double,b:double>,b:struct<r:double,g:double,b:double>,c:struct<r:double,g:double,b:double>>>"
DECODED = "tileset_id long, node_path string, batch_id int, id string, tri " + mesh.TRIANGLES + ", uv " + UVS + ", colors " + COLORS + ", rgba array<double>, texture string, props map<string,string>"


def read_tiles(spark: SparkSession, tilesets: DataFrame) -> DataFrame:
    """Features of tilesets(tileset_id, dir_name, tileset_json): triangles by batch id, moved by the transforms above them; see DECODED.

    The translation is the sum of those from the root child above a tile down to it.
    """
    cols = nested.tile_columns(tilesets)
    t = nested.tiles(cols).filter("content_uri like '%.b3dm%'")
    moves = nested.transforms(cols).select("record_id", F.col("node_path").alias("above"), *[F.col("matrix")[12 + i].alias("t" + k) for i, k in enumerate(G.AXES)])
    # the root's own transform holds for its own content only
    steps = F.split("node_path", r"\.")
    above = F.when(F.size(steps) == 1, F.array("node_path")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda n: F.array_join(F.slice(steps, 1, n), ".")))
    sums = t.select("record_id", "node_path", F.explode(above).alias("above")).join(moves, ["record_id", "above"]).groupBy("record_id", "node_path").agg(*[F.sum("t" + k).alias("t" + k) for k in G.AXES])
    t = t.join(sums, ["record_id", "node_path"], "left").fillna(0.0, ["tx", "ty", "tz"])
    t = t.join(tilesets.select(F.col("tileset_id").alias("record_id"), "dir_name"), "record_id")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec, node, folder, uri, *move in zip(b["record_id"], b["node_path"], b["dir_name"], b["content_uri"], b["tx"], b["ty"], b["tz"], strict=True):
                with open(os.path.join(folder, uri.split("?")[0]), "rb") as f:
                    _, table, primitives, materials = tile_codec.decode_b3dm(f.read())
                found: dict = {}
                path = os.path.join(folder, os.path.dirname(uri))
                for p in primitives:
                    owner = p["batch_ids"].reshape(-1, 3)[:, 0]
                    pos = p["positions"].astype(float).reshape(-1, 3, 3) + np.array(move)
                    material = materials[p["material"]]
                    for i in np.unique(owner):
                        at = owner == i
                        tri, uv, colors, _, _ = found.setdefault(int(i), ([], [], [], material["rgba"], os.path.join(path, material["texture"]) if material.get("texture") else None))
                        for out, name, keys in ((uv, "uvs", "uv"), (colors, "colors", "rgb")):
                            if p[name] is not None:
                                own = p[name].astype(float)[:, : len(keys)].reshape(-1, 3, len(keys))[at].tolist()
                                out += [dict(zip("abc", (dict(zip(keys, q, strict=True)) for q in x), strict=True)) for x in own]
                        tri += [dict(zip("abc", ({"x": q[0], "y": q[1], "z": q[2]} for q in x), strict=True)) for x in pos[at].tolist()]
                for i, (tri, uv, colors, rgba, texture) in sorted(found.items()):
                    at = lambda k, i=i, table=table: table[k][i] if isinstance(table.get(k), list) and i < len(table[k]) else None
                    name = at("id")
                    full = lambda x, tri=tri: x if len(x) == len(tri) else None
                    rows.append((rec, node, i, str(i) if name is None else str(name), tri, full(uv), full(colors), rgba, texture if full(uv) else None, {k: str(at(k)) for k in table if k not in ("id", "extensions") and at(k) is not None}))
            yield pd.DataFrame(rows, columns=["tileset_id", "node_path", "batch_id", "id", "tri", "uv", "colors", "rgba", "texture", "props"])

    return t.select("record_id", "node_path", "dir_name", "content_uri", "tx", "ty", "tz").mapInPandas(decode, DECODED)


def merge_tilesets(documents: list[dict]) -> dict:
    """The children of all roots below one new root."""
    children = [c for d in documents for c in d.get("root", {}).get("children", [])]
    return {"asset": {"version": "1.0"}, "geometricError": grouping.ROOT_ERROR, "root": {"boundingVolume": {"box": [0] * 12}, "geometricError": grouping.ROOT_ERROR, "refine": "ADD", "children": children}}


def tree_places(tiles_: DataFrame) -> DataFrame:
    """tiles_(record_id, node_path, parent_path), each once, with the number of children and whether a tile is a root or a leaf."""
    n = tiles_.filter("parent_path <> ''").groupBy("record_id", F.col("parent_path").alias("node_path")).agg(F.count("*").alias("n_children"))
    t = tiles_.select("record_id", "node_path", "parent_path").join(n, ["record_id", "node_path"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    return t.select("record_id", "node_path", "n_children", (F.col("parent_path") == "").alias("is_root"), (F.col("n_children") == 0).alias("is_leaf"))


def merged_children(tilesets: DataFrame) -> DataFrame:
    """(record_id, node_path, merged_path): the children of all roots below one new root, in order of tilesets and places."""
    t = nested.tiles(nested.tile_columns(tilesets)).filter("depth = 1").withColumn("place", F.element_at(F.split("node_path", r"\."), -1).cast("int"))
    return row_numbers(t, ["record_id", "place"], "no").select("record_id", "node_path", F.concat(F.lit("0."), F.col("no").cast("string")).alias("merged_path"))


def write_obj(features: DataFrame, path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> int:
    """One mesh file: equal vertices once in order of first use, with the color of the first one if there are colors; equal normals once; faces by feature and triangle. Returns the number of faces.

    The file is one by nature; rows stream through the driver in order and are never held together.
    """
    colored = "colors" in features.columns
    f = with_geometry(features).select("ord", G.translate(F.col("tri"), *[F.lit(float(x)) for x in offset]).alias("tri"), *(["colors"] if colored else []))
    t = f.select("ord", F.posexplode("tri").alias("k", "t"), *(["colors"] if colored else []))
    color = lambda c: F.get(F.col("colors"), F.col("k"))[c] if colored else F.lit(None).cast("struct<r:double,g:double,b:double>")
    corner = F.array(*[F.struct(F.col(f"t.{c}.x").alias("x"), F.col(f"t.{c}.y").alias("y"), F.col(f"t.{c}.z").alias("z"), color(c).alias("color")) for c in "abc"])
    v = t.select("ord", "k", F.posexplode(corner).alias("c", "p")).select(F.struct("ord", "k", "c").alias("at"), "p.*")
    index = stored(grouping.vertex_index(v, "at", carry=("color",)))
    n = G.normal(F.col("t"))
    faces = t.select(F.struct("ord", "k").alias("at"), *[(n[k] + 0.0).alias(k) for k in G.AXES])
    normals = stored(grouping.vertex_index(faces, "at"))
    count = 0
    with open(path, "w") as out:
        for r in index.orderBy("vertex_no").toLocalIterator():
            out.write(f"v {r.x!r} {r.y!r} {r.z!r}" + (f" {r.color.r!r} {r.color.g!r} {r.color.b!r}\n" if r.color else "\n"))
        for r in normals.orderBy("vertex_no").toLocalIterator():
            out.write(f"vn {r.x!r} {r.y!r} {r.z!r}\n")
        named = v.join(index.select("x", "y", "z", "vertex_no"), ["x", "y", "z"]).groupBy("at.ord", "at.k").agg(*[F.max(F.when(F.col("at.c") == i, F.col("vertex_no"))).alias(x) for i, x in enumerate("abc")])
        own = faces.join(normals, ["x", "y", "z"]).select("at.ord", "at.k", F.col("vertex_no").alias("n"))
        for r in named.join(own, ["ord", "k"]).orderBy("ord", "k").toLocalIterator():
            out.write(f"f {r.a}//{r.n} {r.b}//{r.n} {r.c}//{r.n}\n")
            count += 1
    return count
