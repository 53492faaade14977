"""Input files: expansion of paths, GeoJSON features, zones, meshes, lineage graphs, tilesets, colors, city databases."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.functions import geometry as G
from geostrata.operators import lineage

GEOJSON, OBJ = (".geojson", ".json"), (".obj",)


def expand(paths: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Files as they are, folders as their files of the suffixes (not below them); sorted. None at all is an error."""
    out = []
    for p in paths:
        out += [str(f) for f in Path(p).iterdir() if f.is_file() and f.suffix.lower() in suffixes] if os.path.isdir(p) else [p]
    if not out:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} file in {paths}")
    return sorted(out)


def _texts(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_no, text) of whole files; file_no is the place in the sorted list."""
    names = spark.createDataFrame([(i, os.path.basename(f), os.path.abspath(f)) for i, f in enumerate(files)], "file_no int, base string, path string")
    t = spark.read.text(files, wholetext=True).select(F.col("value").alias("text"), F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/").alias("path"))
    # one row a file
    return t.join(F.broadcast(names), "path")


FEATURE = "struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>"


def geojson(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, id, properties, geom_type, coordinates) of every feature, in order of files and places.

    The id is properties.ID, else feature_<k>, k counting a file's features without one.
    """
    t = _texts(spark, expand(paths, GEOJSON))
    # strings take any JSON below them as it is written
    f = F.from_json("text", f"struct<features:array<{FEATURE}>>")["features"]
    rows = t.select("file_no", F.posexplode(f).alias("pos", "f"))
    rows = rows.select("file_no", "pos", "f.properties", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    own = F.get_json_object("properties", "$.ID")
    k = F.row_number().over(Window.partitionBy("file_no", own.isNull()).orderBy("pos")) - 1
    return rows.select((F.col("file_no").cast("bigint") * 1_000_000_000 + F.col("pos")).alias("ord"), F.coalesce(own, F.concat(F.lit("feature_"), k.cast("string"))).alias("id"), "properties", "geom_type", "coordinates")


def rings(geom_type, coordinates, strict: bool = False):
    """array of rings (arrays of points) of a polygon, of a multi-polygon's first part, or of a line as one ring; a missing type gives null, other types are an error when strict, else null.

    A point without coordinates keeps its place, with nulls (see filled_points).
    """
    pts = lambda r: F.transform(r, lambda a: G.point(*[F.get(a, F.lit(i)) for i in range(3)]))
    three = F.from_json(coordinates, "array<array<array<double>>>")
    return (
        F.when(geom_type == "Polygon", F.transform(three, pts))
        .when(geom_type == "MultiPolygon", F.transform(F.try_element_at(F.from_json(coordinates, "array<array<array<array<double>>>>"), F.lit(1)), pts))
        .when(geom_type == "LineString", F.array(pts(F.from_json(coordinates, "array<array<double>>"))))
        .when(geom_type == "MultiLineString", F.slice(F.transform(three, pts), 1, 1))
        .when(F.lit(strict) & geom_type.isNotNull(), F.raise_error(F.concat(F.lit("no geometry of type "), geom_type)))
    )


def filled_points(ring):
    """A ring's points without those that have no x or no y."""
    return F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def zones(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(zone_id, ring) of polygons: the first part's exterior without its closing point; other types are left out."""
    g = geojson(spark, paths).filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    ext = G.open_ring(filled_points(F.try_element_at(rings(F.col("geom_type"), F.col("coordinates")), F.lit(1))))
    return g.select(F.col("ord").alias("zone_id"), F.transform(ext, lambda p: F.struct(p["x"], p["y"])).alias("ring")).filter("size(ring) >= 3")


def _materials(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(folder, lib, material, rgba, picture) of the material files in folders, read by tasks; opacity from d or Tr, picture from map_Kd."""
    libs = [f"{d}/*.mtl" for d in folders if any(Path(d).glob("*.mtl"))]
    schema = "folder string, lib string, material string, rgba array<double>, picture string"
    if not libs:
        return spark.createDataFrame([], schema)

    def parse(batches):
        import pandas as pd

        for t in batches:
            rows = []
            for text, path in zip(t["text"], t["path"], strict=True):
                folder, _, lib = path.rpartition("/")
                name, own = None, {}
                for line in text.splitlines():
                    w = line.split()
                    if not w:
                        continue
                    if w[0] == "newmtl":
                        name = " ".join(w[1:])
                        own[name] = [[0.8, 0.8, 0.8, 1.0], None]
                    elif name and w[0] == "Kd":
                        own[name][0][:3] = [float(x) for x in w[1:4]]
                    elif name and w[0] in ("d", "Tr"):
                        own[name][0][3] = float(w[1]) if w[0] == "d" else 1 - float(w[1])
                    elif name and w[0] == "map_Kd":
                        own[name][1] = os.path.normpath(folder + "/" + w[-1].replace("\\", "/"))
                rows += [(folder, lib, n, rgba, picture) for n, (rgba, picture) in own.items()]
            yield pd.DataFrame(rows, columns=["folder", "lib", "material", "rgba", "picture"])

    t = spark.read.text(libs, wholetext=True).select(F.col("value").alias("text"), F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/").alias("path"))
    return t.mapInPandas(parse, schema)


def pictures(spark: SparkSession, features: DataFrame) -> DataFrame:
    """(texture, data) of the picture files that features name in 'texture', read by tasks; missing files have none."""

    def read(batches):
        import pandas as pd

        for t in batches:
            own = [p for p in t["texture"] if os.path.isfile(p)]
            yield pd.DataFrame({"texture": own, "data": [Path(p).read_bytes() for p in own]})

    return features.filter("texture is not null").select("texture").distinct().mapInPandas(read, "texture string, data binary")


def obj(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[dict], DataFrame]:
    """(ord, id, tri, uv, colors, rgba, texture) of each material of each mesh file, the palette of the default material, and the pictures.

    Faces are fans of triangles; v is turned over; colors are those of the vertices where all have one. Files without faces
    give nothing. A file is parsed whole in one task, as its faces refer to vertices anywhere in it. Normals come from the faces.
    """
    files = expand(paths, OBJ)
    palette: list[dict] = [{"rgba": [1.0, 1.0, 1.0, 1.0], "metallic": 0.0, "roughness": 1.0, "double_sided": True}]
    p3, p2, c3 = "struct<x:double,y:double,z:double>", "struct<u:double,v:double>", "struct<r:double,g:double,b:double>"
    schema = f"file_no int, part int, id string, folder string, libs array<string>, tri array<struct<a:{p3},b:{p3},c:{p3}>>, uv array<struct<a:{p2},b:{p2},c:{p2}>>, colors array<struct<a:{c3},b:{c3},c:{c3}>>"

    def parse(batches):
        import pandas as pd

        def named(rows, keys):
            return [dict(zip("abc", (dict(zip(keys, p, strict=True)) for p in q), strict=True)) for q in rows]

        for t in batches:
            rows = []
            for no, text, base, path in zip(t["file_no"], t["text"], t["base"], t["path"], strict=True):
                v, vt, colors, parts, libs, name = [], [], [], {}, [], os.path.splitext(base)[0]
                for line in text.splitlines():
                    w = line.split()
                    if not w:
                        continue
                    if w[0] == "v":
                        v.append(tuple(map(float, w[1:4])))
                        colors.append(tuple(map(float, w[4:7])) if len(w) >= 7 else None)
                    elif w[0] == "vt":
                        vt.append((float(w[1]), 1 - float(w[2]) if len(w) > 2 else 1.0))
                    elif w[0] == "mtllib":
                        libs.append(line.split(None, 1)[1].strip())
                    elif w[0] == "usemtl":
                        name = " ".join(w[1:])
                    elif w[0] == "f":
                        c = [x.split("/") for x in w[1:]]
                        at = [int(x[0]) - 1 if int(x[0]) > 0 else int(x[0]) for x in c]
                        uv = [int(x[1]) - 1 if int(x[1]) > 0 else int(x[1]) for x in c if len(x) > 1 and x[1]]
                        tris, uvs, shades = parts.setdefault(name, ([], [], []))
                        for i in range(1, len(at) - 1):
                            tris.append([v[at[j]] for j in (0, i, i + 1)])
                            shades.append([colors[at[j]] for j in (0, i, i + 1)])
                            uvs.append([vt[uv[j]] for j in (0, i, i + 1)] if len(uv) == len(at) else None)
                for k, (n, (tris, uvs, shades)) in enumerate(parts.items()):
                    full = uvs and all(u is not None for u in uvs)
                    shaded = all(x is not None for q in shades for x in q)
                    rows.append((no, k, n, path.rpartition("/")[0], libs, named(tris, "xyz"), named(uvs, "uv") if full else None, named(shades, "rgb") if shaded else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("file_no", "part", "id", "folder", "libs", "tri", "uv", "colors")])

    raw = _texts(spark, files).select("file_no", "text", "base", "path").mapInPandas(parse, schema)
    m = _materials(spark, sorted({os.path.dirname(os.path.abspath(f)) for f in files})).withColumnsRenamed({"folder": "own_folder", "material": "own_id"})
    # one row a material; of a name that several libraries of a file have the last in text order counts
    met = raw.select("file_no", "part", "id", "folder", F.explode("libs").alias("lib")).join(m.withColumnRenamed("lib", "own_lib"), (F.col("folder") == F.col("own_folder")) & (F.col("lib") == F.col("own_lib")) & (F.col("id") == F.col("own_id")))
    met = met.groupBy("file_no", "part").agg(F.max(F.struct("lib", "rgba", "picture")).alias("m"))
    out = raw.join(met, ["file_no", "part"], "left").select((F.col("file_no").cast("bigint") * 1_000_000 + F.col("part")).alias("ord"), "id", "tri", "uv", "colors", F.col("m.rgba").alias("rgba"), F.when(F.col("uv").isNotNull(), F.col("m.picture")).alias("texture"))
    return out, palette, pictures(spark, out)


def lineage_graph(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of graph files; numbers may be strings, re-ided is re_ided, edges name their ends by number."""
    vs, es = [], []
    for f in paths:
        t = spark.read.text([f], wholetext=True).select(F.from_json("value", "struct<nodes:array<struct<id:string,globalid:string>>,edges:array<struct<id:string,source:string,target:string,type:string,tags:string>>>").alias("g"))
        n = t.select(F.explode("g.nodes").alias("n")).select(F.col("n.id").cast("int").alias("id"), "n.globalid")
        tags = F.when(F.col("e.tags").startswith("["), F.from_json("e.tags", "array<string>")).otherwise(F.array("e.tags"))
        e = t.select(F.explode("g.edges").alias("e")).select(F.col("e.id").cast("int").alias("edge_id"), F.col("e.source").cast("int").alias("s"), F.col("e.target").cast("int").alias("t"), "e.type", F.transform(tags, lambda x: F.regexp_replace(x, "^re-ided$", "re_ided")).alias("tags"))
        e = e.join(n.select(F.col("id").alias("s"), F.col("globalid").alias("src")), "s").join(n.select(F.col("id").alias("t"), F.col("globalid").alias("dst")), "t")
        vs.append(lineage.vertices_of(n))
        es.append(e.select("edge_id", "src", "dst", "type", "tags"))
    return lineage.union(vs, es)


def tilesets(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(tileset_id, dir_name, tileset_json) of folders with a tileset.json, in the order given, read by tasks; other paths are left out."""
    own = [os.path.abspath(f) for f in folders if os.path.isfile(f"{f}/tileset.json")]
    names = spark.createDataFrame([(i, d, f"{d}/tileset.json") for i, d in enumerate(own)], "tileset_id long, dir_name string, path string")
    if not own:
        return names.select("tileset_id", "dir_name", F.col("path").alias("tileset_json"))
    t = spark.read.text([f"{d}/tileset.json" for d in own], wholetext=True).select(F.col("value").alias("tileset_json"), F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/").alias("path"))
    return names.join(t, "path").select("tileset_id", "dir_name", "tileset_json")


# The default colors.
DEFAULT_COLORS = {"default_color": [1, 1, 1], "min_color": [0, 1, 0], "max_color": [1, 0, 0], "nb_colors": 20, "color_dict": {"default": [1, 1, 1]}, "double_sided": True, "metallic_factor": 0, "roughness_factor": 1}


def colors(path: str | None = None) -> dict:
    """A color file over the defaults; a missing file is the defaults."""
    return DEFAULT_COLORS | own_colors(path)


def own_colors(path: str | None) -> dict:
    return json.loads(Path(path).read_text()) if path and os.path.exists(path) else {}


def rgba(color) -> list[float]:
    """A list of three or four numbers, or a hexadecimal text."""
    if isinstance(color, str):
        h = color.removeprefix("#").removeprefix("0x")
        color = [round(int(h[i : i + 2], 16) / 255, 4) for i in range(0, len(h), 2)]
    return [float(x) for x in color] + [1.0] * (4 - len(color))


def ramp(config: dict) -> list[list[float]]:
    """The colors of a numeric ramp, from min towards max."""
    low, high, n = rgba(config["min_color"]), rgba(config["max_color"]), config["nb_colors"]
    return [[(b - a) * i / n + a for a, b in zip(low, high, strict=True)] for i in range(n)]


# What a connection file must name.
DB_KEYS = ("PG_HOST", "PG_PORT", "PG_NAME", "PG_USER", "PG_PASSWORD")


def _connection(config_path: str) -> dict:
    import yaml

    c = yaml.safe_load(Path(config_path).read_text()) or {}
    missing = [k for k in DB_KEYS if not c.get(k)]
    if missing:
        raise ValueError(f"missing in {config_path}: {', '.join(missing)}")
    return c


def database_name(config_path: str) -> str:
    """What a tileset says of where it comes from: host and name of the database, or the folder."""
    if os.path.isdir(config_path):
        return os.path.basename(os.path.abspath(config_path))
    c = _connection(config_path)
    return f"{c['PG_HOST']}/{c['PG_NAME']}"


def city_tables(spark: SparkSession, config_path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a city database: a folder of parquet files, or a connection file with host, port, name, user and password."""
    if os.path.isdir(config_path):
        return {n: spark.read.parquet(f"{config_path}/{n}.parquet") for n in names}
    c = _connection(config_path)
    url = f"jdbc:postgresql://{c['PG_HOST']}:{c['PG_PORT']}/{c['PG_NAME']}"
    return {n: spark.read.format("jdbc").options(url=url, dbtable=f"citydb.{n}", user=c["PG_USER"], password=c["PG_PASSWORD"]).load() for n in names}
