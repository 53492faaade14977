"""Command line: python -m geostrata.cli KIND --paths ... (kinds: geojson, obj, city, temporal, ifc, reader, merger)."""

from __future__ import annotations

import argparse

from geostrata.operators import ifc_model
from geostrata.plans import pipelines as P
from geostrata.runtime import session

KINDS = ("geojson", "obj", "city", "temporal", "ifc", "reader", "merger")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geostrata", description=__doc__)
    p.add_argument("kind", choices=KINDS)
    p.add_argument("--paths", "--path", "--db_config_path", "--file_path", "-i", dest="paths", nargs="+", required=True)
    p.add_argument("--output_dir", "--out", "-o", dest="output_dir", default="tileset")
    p.add_argument("--obj")
    p.add_argument("--loa")
    p.add_argument("--lod1", action="store_true")
    p.add_argument("--offset", nargs="*")
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--height_mult", type=float, default=1.0)
    p.add_argument("--crs_in", default="EPSG:3946")
    p.add_argument("--crs_out", default="EPSG:3946")
    p.add_argument("--no_normals", action="store_true")
    p.add_argument("--geometric_error", nargs="*")
    p.add_argument("--kd_tree_max", type=int)
    p.add_argument("--with_texture", action="store_true")
    p.add_argument("--texture_lods", "--tl", type=int, default=0)
    p.add_argument("--format", default="png", type=str.lower, choices=["png"])
    p.add_argument("--quality", type=int, default=75, help="of lossy formats, which aren't written")
    p.add_argument("--compress_level", type=int, default=6)
    p.add_argument("--with_BTH", action="store_true")
    p.add_argument("--keep_ids", nargs="*", default=[])
    p.add_argument("--exclude_ids", nargs="*", default=[])
    p.add_argument("--as_lods", action="store_true")
    p.add_argument("--height", default="HAUTEUR")
    p.add_argument("--width", default="LARGEUR")
    p.add_argument("--z", default="NONE")
    p.add_argument("--prec", default="PREC_ALTI")
    p.add_argument("--is_roof", action="store_true")
    p.add_argument("--keep_properties", "-k", action="store_true")
    p.add_argument("--add_color", nargs="*")
    p.add_argument("--color_config")
    p.add_argument("--type", dest="city_type", choices=sorted(P.CITY), default="building")
    p.add_argument("--split_surfaces", action="store_true")
    p.add_argument("--grouped_by", choices=sorted(ifc_model.GROUPS), default="IfcTypeObject")
    p.add_argument("--time_stamps", nargs="*", type=int, default=[])
    p.add_argument("--temporal_graph", nargs="*", default=[])
    return p


def options(a: argparse.Namespace) -> P.Options:
    own = {k: v for k, v in vars(a).items() if k not in ("kind", "paths")}
    color = own.pop("add_color")
    # city objects are colored by class, which needs no attribute
    own["add_color"] = None if color is None else (color[0] if color else "", color[1] if len(color) > 1 else "semantic")
    own["offset"] = P.offset_of(own["offset"])
    own["geometric_error"] = P.errors_of(own["geometric_error"])
    return P.Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    o = options(a)
    if a.kd_tree_max is not None and a.kd_tree_max <= 0:
        raise SystemExit("--kd_tree_max must be above 0")
    if a.kind == "merger":
        P.merger(a.paths, o.output_dir)
        return
    spark = session("geostrata")
    if a.kind == "city":
        P.city(spark, a.paths[0], o)
    elif a.kind == "ifc":
        P.ifc(spark, spark.read.parquet(*a.paths), o)
    else:
        {"geojson": P.geojson, "obj": P.obj, "temporal": P.temporal, "reader": P.reader}[a.kind](spark, a.paths, o)


if __name__ == "__main__":
    main()
