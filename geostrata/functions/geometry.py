"""Geometry as column expressions: bounding boxes, transforms, rings, textures' coordinates, colors and map projections.

A point is struct<x,y,z>, a triangle struct<a,b,c> of points, a geometry an array of triangles. Null geometries give
null; empty ones have no box.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
TRIANGLES = "array<struct<a:struct<x:double,y:double,z:double>,b:struct<x:double,y:double,z:double>,c:struct<x:double,y:double,z:double>>>"


def point(x, y, z) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"), as_col(z).cast("double").alias("z"))


def map_points(tri: Column, f: Callable[[Column], Column]) -> Column:
    """Every corner through f."""
    return F.transform(tri, lambda t: F.struct(f(t["a"]).alias("a"), f(t["b"]).alias("b"), f(t["c"]).alias("c")))


def corners(tri: Column) -> Column:
    return F.flatten(F.transform(tri, lambda t: F.array(t["a"], t["b"], t["c"])))


def bbox(tri: Column) -> Column:
    """struct<xmin,ymin,zmin,xmax,ymax,zmax>; null without corners."""
    p = corners(tri)
    ends = [f(_axis(p, k)).alias(k + n) for f, n in ((F.array_min, "min"), (F.array_max, "max")) for k in AXES]
    return F.when(F.size(p) > 0, F.struct(*ends))


def _axis(points: Column, axis: str) -> Column:
    return F.transform(points, lambda q: q[axis])


def center(box: Column) -> Column:
    return point(*[(box[k + "min"] + box[k + "max"]) / 2 for k in AXES])


def box12(box: Column) -> Column:
    """Center and three half axes as 12 numbers, as bounding volumes are written."""
    h = {k: (box[k + "max"] - box[k + "min"]) / 2 for k in AXES}
    c = center(box)
    zero = F.lit(0.0)
    return F.array(c["x"], c["y"], c["z"], h["x"], zero, zero, zero, h["y"], zero, zero, zero, h["z"])


def translate(tri: Column, dx, dy, dz) -> Column:
    return map_points(tri, lambda p: point(p["x"] + dx, p["y"] + dy, p["z"] + dz))


def scale_about(tri: Column, factor, c: Column) -> Column:
    return map_points(tri, lambda p: point((p["x"] - c["x"]) * factor + c["x"], (p["y"] - c["y"]) * factor + c["y"], (p["z"] - c["z"]) * factor + c["z"]))


def multiply_height(tri: Column, factor) -> Column:
    return map_points(tri, lambda p: point(p["x"], p["y"], p["z"] * factor))


def y_up(tri: Column) -> Column:
    """From z up to y up: (x, z, -y)."""
    return map_points(tri, lambda p: point(p["x"], p["z"], -p["y"]))


def cross(t: Column) -> Column:
    """(b - a) x (c - a)."""
    u = {k: t["b"][k] - t["a"][k] for k in AXES}
    v = {k: t["c"][k] - t["a"][k] for k in AXES}
    return point(u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"])


def normal(t: Column) -> Column:
    """Unit normal of a triangle; (0, 0, 1) for one without area."""
    n = cross(t)
    size = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
    return F.when(size > 0, point(n["x"] / size, n["y"] / size, n["z"] / size)).otherwise(point(0, 0, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace over a ring given without its closing point; positive when counter-clockwise. Taken relative to the first point, as map coordinates are large."""
    first = F.get(ring, F.lit(0))
    ring = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2


def open_ring(ring: Column) -> Column:
    """Without the closing point."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def clockwise(ring: Column) -> Column:
    """Open ring in clockwise order."""
    r = open_ring(ring)
    return F.when(signed_area(r) > 0, F.reverse(r)).otherwise(r)


def clean_rings(exterior: Column, holes: Column) -> tuple[Column, Column]:
    """Exterior without repeated points; holes that share a point with it dropped, points repeated in any hole kept once."""
    ext = F.array_distinct(exterior)
    kept = F.filter(holes, lambda h: ~F.arrays_overlap(h, exterior))
    start = F.struct(F.array().cast("array<struct<x:double,y:double,z:double>>").alias("seen"), F.array().cast("array<array<struct<x:double,y:double,z:double>>>").alias("out"))

    def add(acc: Column, h: Column) -> Column:
        own = F.array_distinct(F.filter(h, lambda p: ~F.array_contains(acc["seen"], p)))
        return F.struct(F.concat(acc["seen"], own).alias("seen"), F.concat(acc["out"], F.array(own)).alias("out"))

    return ext, F.aggregate(kept, start, add, lambda acc: acc["out"])


def literal_number(option: str) -> float | None:
    """An option that is a plain unsigned number is a constant; anything else names a property."""
    head, dot, tail = option.partition(".")
    return float(option) if (head + tail).isdigit() and (not dot or tail.isdigit()) and head.isdigit() else None


def resolved(option: str, prop: Callable[[str], Column], default: float) -> Column:
    """Height or width: a constant, or the property when it is above 0, else the default."""
    number = literal_number(option)
    if number is not None:
        return F.lit(number)
    v = prop(option).try_cast("double")
    return F.when(v > 0, v).otherwise(F.lit(float(default)))


def resolved_z(option: str, prop: Callable[[str], Column], own: Column) -> Column:
    """Base height: a constant, a property, or the coordinate's own; 0 where there is none."""
    number = literal_number(option)
    if number is not None:
        return F.lit(number)
    v = own if option.upper() == "NONE" else F.coalesce(prop(option).try_cast("double"), own)
    return F.coalesce(v, F.lit(0.0))


def walls(ring: Column, height: Column) -> Column:
    """Two triangles an edge, from each point up by height; the ring is open."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    up = lambda p: point(p["x"], p["y"], p["z"] + height)
    both = F.zip_with(ring, after, lambda p, q: F.array(F.struct(p.alias("a"), q.alias("b"), up(q).alias("c")), F.struct(p.alias("a"), up(q).alias("b"), up(p).alias("c"))))
    return F.when(F.size(ring) >= 3, F.flatten(both)).otherwise(F.slice(F.flatten(both), 1, 0))


def strip(ring: Column, z: Column) -> Column:
    """Roof of a buffered line: quads between the two sides of a ring of 2n points."""
    n = F.size(ring)
    at = lambda k: F.element_at(ring, k.cast("int") + 1)
    lift = lambda p: point(p["x"], p["y"], z)
    quad = lambda i: F.array(
        F.struct(lift(at(i)).alias("a"), lift(at(i + 1)).alias("b"), lift(at(n - 2 - i)).alias("c")),
        F.struct(lift(at(i)).alias("a"), lift(at(n - 2 - i)).alias("b"), lift(at(n - 1 - i)).alias("c")),
    )
    return F.when(n >= 4, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 2), quad)))


def min_z(tri: Column) -> Column:
    return F.array_min(_axis(corners(tri), "z"))


def mean_max_z(tri: Column) -> Column:
    """Mean over triangles of each one's highest corner."""
    tops = F.transform(tri, lambda t: F.greatest(t["a"]["z"], t["b"]["z"], t["c"]["z"]))
    return F.aggregate(tops, F.lit(0.0), lambda a, b: a + b) / F.size(tri)


def plane_mean(points: Column) -> Column:
    """Mean of points in the plane, at height 0."""
    mean = lambda k: F.aggregate(_axis(points, k), F.lit(0.0), lambda a, b: a + b) / F.size(points)
    return F.when(F.size(points) > 0, point(mean("x"), mean("y"), 0))


def uv_bounds(uv: Column) -> Column:
    p = F.flatten(F.transform(uv, lambda t: F.array(t["a"], t["b"], t["c"])))
    return F.struct(*[f(_axis(p, k)).alias(k + n) for f, n in ((F.array_min, "min"), (F.array_max, "max")) for k in ("u", "v")])


def uv_crop(value: Column, low: Column, high: Column) -> Column:
    """Renormalised to its own bounds; where they are one value the size counts as 1."""
    return (value - low) / F.when(high > low, high - low).otherwise(1.0)


def uv_place(value: Column, size: Column, offset: Column, whole: Column) -> Column:
    """Into the atlas: scaled to the image's share and moved to its place."""
    return value * size / whole + offset / whole


def power_of_two(n: Column) -> Column:
    """The first power of two that isn't below n, at least 1."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(n, F.lit(1e-9)))).cast("double"))).cast("int")


def hex_color(text: Column) -> Column:
    """#rrggbb or 0xrrggbb[aa] as numbers from 0 to 1, rounded to 4 places; alpha 1 where missing."""
    digits = F.regexp_replace(text, "^(#|0x)", "")
    part = lambda i: F.round(F.conv(F.substring(digits, i, 2), 16, 10).cast("int") / 255, 4)
    return F.array(part(1), part(3), part(5), F.when(F.length(digits) >= 8, part(7)).otherwise(F.lit(1.0)))


def ramp_index(value: Column, low: Column, high: Column, colors: int = 20) -> Column:
    """1-based material index in a ramp, rounded half to even; 1 when all values are one."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    return (F.bround(share * (colors - 1), 0) + 1).cast("int")


def grid_cell(value: Column, size: float = 1000.0) -> Column:
    """The nearest multiple of size, halves to even; never minus zero."""
    return F.bround(value / size, 0) * size + 0.0


# The GRS80 ellipsoid and the conic conformal zones CC46 (EPSG:3946) and Lambert-93 (EPSG:2154).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
CC46 = {"lat0": 46.0, "lon0": 3.0, "sp1": 45.25, "sp2": 46.75, "fe": 1700000.0, "fn": 5200000.0}
LAMBERT93 = {"lat0": 46.5, "lon0": 3.0, "sp1": 44.0, "sp2": 49.0, "fe": 700000.0, "fn": 6600000.0}
ZONES = {"EPSG:3946": CC46, "EPSG:2154": LAMBERT93}
E2 = GRS80_F * (2 - GRS80_F)
E = math.sqrt(E2)


def _conic(zone: dict) -> tuple[float, float, float]:
    """(cone constant, radius factor, radius of the origin)."""
    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - E2 * math.sin(math.radians(d)) ** 2)
    t = lambda d: math.tan(math.pi / 4 - math.radians(d) / 2) / ((1 - E * math.sin(math.radians(d))) / (1 + E * math.sin(math.radians(d)))) ** (E / 2)
    n = (math.log(m(zone["sp1"])) - math.log(m(zone["sp2"]))) / (math.log(t(zone["sp1"])) - math.log(t(zone["sp2"])))
    f = m(zone["sp1"]) / (n * t(zone["sp1"]) ** n)
    return n, f, GRS80_A * f * t(zone["lat0"]) ** n


CONE, FACTOR, RADIUS0 = _conic(CC46)


def conic_to_geographic(x: Column, y: Column, zone: dict = CC46) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of conic coordinates, by six rounds of the inverse's fixed point."""
    cone, factor, radius0 = _conic(zone)
    dx, dy = x - F.lit(zone["fe"]), F.lit(radius0) - (y - F.lit(zone["fn"]))
    r = F.sqrt(dx * dx + dy * dy)
    t = F.pow(r / F.lit(GRS80_A * factor), F.lit(1 / cone))
    lon = F.atan2(dx, dy) / F.lit(cone)
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(6):
        s = F.lit(E) * F.sin(lat)
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(E / 2)))
    return F.degrees(lat), F.degrees(lon) + F.lit(zone["lon0"])


def geographic_to_conic(lat: Column, lon: Column, zone: dict = CC46) -> tuple[Column, Column]:
    cone, factor, radius0 = _conic(zone)
    p = F.radians(lat)
    s = F.lit(E) * F.sin(p)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))
    r = F.lit(GRS80_A * factor) * F.pow(t, F.lit(cone))
    a = F.lit(cone) * F.radians(lon - F.lit(zone["lon0"]))
    return F.lit(zone["fe"]) + r * F.sin(a), F.lit(zone["fn"]) + F.lit(radius0) - r * F.cos(a)


def geocentric_to_geographic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, height) by Bowring's closed form, exact to far below a millimetre near the ground; rounds would copy the expression into itself."""
    flat, minor = F.sqrt(x * x + y * y), GRS80_A * math.sqrt(1 - E2)
    reduced = F.atan2(z * F.lit(GRS80_A), flat * F.lit(minor))
    lat = F.atan2(z + F.lit(E2 / (1 - E2) * minor) * F.pow(F.sin(reduced), F.lit(3.0)), flat - F.lit(E2 * GRS80_A) * F.pow(F.cos(reduced), F.lit(3.0)))
    n = F.lit(GRS80_A) / F.sqrt(1 - F.lit(E2) * F.pow(F.sin(lat), F.lit(2.0)))
    # along the axis or across it, whichever is longer
    h = F.when(F.abs(F.cos(lat)) > 0.5, flat / F.cos(lat) - n).otherwise(z / F.sin(lat) - n * F.lit(1 - E2))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


def mercator_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(GRS80_A))) - F.lit(math.pi / 2)), F.degrees(x / F.lit(GRS80_A))


def geographic_to_geocentric(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(GRS80_A) / F.sqrt(1 - F.lit(E2) * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * F.lit(1 - E2) + h) * F.sin(p)


def geographic_to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web Mercator (EPSG:3857)."""
    return F.lit(GRS80_A) * F.radians(lon), F.lit(GRS80_A) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def reproject(x: Column, y: Column, z: Column, crs_in: str, crs_out: str) -> tuple[Column, Column, Column]:
    """Between EPSG:3946, 2154, 4171, 4326, 4978 and 3857; axis order is each system's own (4171: latitude first)."""
    if crs_in == crs_out:
        return x, y, z
    if crs_in in ZONES:
        lat, lon = conic_to_geographic(x, y, ZONES[crs_in])
    elif crs_in in ("EPSG:4171", "EPSG:4326"):
        lat, lon = x, y
    elif crs_in == "EPSG:4978":
        lat, lon, z = geocentric_to_geographic(x, y, z)
    elif crs_in == "EPSG:3857":
        lat, lon = mercator_to_geographic(x, y)
    else:
        raise ValueError(f"no way from {crs_in}")
    if crs_out in ("EPSG:4171", "EPSG:4326"):
        return lat, lon, z
    if crs_out in ZONES:
        return (*geographic_to_conic(lat, lon, ZONES[crs_out]), z)
    if crs_out == "EPSG:4978":
        return geographic_to_geocentric(lat, lon, z)
    if crs_out == "EPSG:3857":
        return (*geographic_to_mercator(lat, lon), z)
    raise ValueError(f"no way to {crs_out}")
