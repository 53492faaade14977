"""Polygon kernels that column expressions can't say: triangulation with holes, hulls, line buffers, well-known binary.

Plain functions on lists of (x, y, z) and, below them, the Arrow functions that bring them to DataFrames.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIANGLES = "array<struct<a:struct<x:double,y:double,z:double>,b:struct<x:double,y:double,z:double>,c:struct<x:double,y:double,z:double>>>"
_POINT = T.StructType([T.StructField(k, T.DoubleType()) for k in "xyz"])
RING_TYPE = T.ArrayType(_POINT)
TRIANGLES_TYPE = T.ArrayType(T.StructType([T.StructField(k, _POINT) for k in "abc"]))

Point = tuple[float, float, float]


def area2(ring: list[Point]) -> float:
    """Twice the signed area; taken relative to the first point, as map coordinates are large."""
    if len(ring) < 3:
        return 0.0
    x0, y0 = ring[0][0], ring[0][1]
    return sum((p[0] - x0) * (q[1] - y0) - (q[0] - x0) * (p[1] - y0) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))


def opened(ring: list[Point]) -> list[Point]:
    """Without the closing point and without points that repeat the one before."""
    out: list[Point] = []
    for p in ring:
        if not out or p[:2] != out[-1][:2]:
            out.append(p)
    while len(out) > 1 and out[0][:2] == out[-1][:2]:
        out.pop()
    return out


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _inside(p: Point, a: Point, b: Point, c: Point) -> bool:
    """Inside or on the rim of a counter-clockwise triangle, its corners aside."""
    if p[:2] in (a[:2], b[:2], c[:2]):
        return False
    return _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments cross at an inner point of both."""
    return _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0


def _between(p: Point, a: Point, b: Point) -> bool:
    """Whether a point lies on a segment, its ends aside."""
    return p[:2] not in (a[:2], b[:2]) and _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _joined(outer: list[Point], holes: list[list[Point]]) -> list[Point]:
    """One ring: each hole is reached by the shortest bridge that crosses no edge, holes from the right first."""
    ring = outer
    todo = sorted((h for h in holes if len(h) >= 3), key=lambda h: -max(p[0] for p in h))
    for n, hole in enumerate(todo):
        k = max(range(len(hole)), key=lambda i: hole[i][0])
        start = hole[k]
        edges = [*zip(ring, [*ring[1:], ring[0]], strict=True), *[e for h in todo[n:] for e in zip(h, [*h[1:], h[0]], strict=True)]]
        for i in sorted(range(len(ring)), key=lambda i: math.dist(ring[i][:2], start[:2])):
            if not any(_cross(start, ring[i], a, b) or _between(a, start, ring[i]) for a, b in edges):
                ring = [*ring[: i + 1], *hole[k:], *hole[: k + 1], *ring[i:]]
                break
    return ring  # a hole that no bridge reaches is missing: the area tells


def _slabs(rings: list[list[Point]]) -> list[tuple[Point, Point, Point]]:
    """Any rings by the even-odd rule: cut at the heights of all points and crossings into trapezoids, at the height of the first point.

    What the rings go around clockwise, as a hole's part outside its exterior, faces down.
    """
    edges = [(p, q, -1) if p[1] < q[1] else (q, p, 1) for r in rings for p, q in zip(r, [*r[1:], r[0]], strict=True) if p[1] != q[1]]
    levels = {p[1] for r in rings for p in r}
    for i, (a, b, _) in enumerate(edges):
        for c, d, _ in edges[:i]:
            if _cross(a, b, c, d):
                s, t = _turn(c, d, a), _turn(c, d, b)
                levels.add(a[1] + (b[1] - a[1]) * s / (s - t))
    order, z, out = sorted(levels), rings[0][0][2], []
    at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
    for low, high in zip(order, order[1:], strict=False):
        mid = (low + high) / 2
        own = sorted((e for e in edges if e[0][1] <= low and e[1][1] >= high), key=lambda e: at(e, mid))
        around = 0
        for left, right in zip(own[::2], own[1::2], strict=False):
            around += left[2]
            a, b, c, d = ((at(e, y), y, z) for e, y in ((left, low), (right, low), (right, high), (left, high)))
            out += [t if around > 0 else t[::-1] for t in ((a, b, c), (a, c, d)) if _turn(*t) > 0]
            around += right[2]
    return out


def triangulate(exterior: list[Point], holes: list[list[Point]] | None = None, own_points: bool = False) -> list[tuple[Point, Point, Point]]:
    """Ear clipping of a polygon with holes; nothing for fewer than three points.

    Rings that touch or cross themselves or each other are cut into trapezoids instead, unless only own_points may be corners.
    """
    outer = opened(exterior)
    if len(outer) < 3:
        return []
    if area2(outer) < 0:
        outer.reverse()
    inner = [opened(h) for h in holes or []]
    inner = [h[::-1] if area2(h) > 0 else h for h in inner]
    ring = _joined(outer, inner)
    left, out, at, idle = list(range(len(ring))), [], 0, 0
    while len(left) > 3 and idle <= len(left):
        i, j, k = left[at - 1], left[at % len(left)], left[(at + 1) % len(left)]
        a, b, c = ring[i], ring[j], ring[k]
        turn = _turn(a, b, c)
        if turn > 0 and not any(_inside(ring[m], a, b, c) for m in left if m not in (i, j, k)):
            out.append((a, b, c))
            del left[at % len(left)]
            idle = 0
        elif turn == 0 and idle > len(left) // 2:  # a point on a straight edge or a bridge's end
            del left[at % len(left)]
            idle = 0
        else:
            at, idle = at + 1, idle + 1
        at %= len(left)
    if len(left) == 3 and _turn(*(ring[m] for m in left)) > 0:
        out.append(tuple(ring[m] for m in left))
    whole = area2(outer) - sum(abs(area2(h)) for h in inner)
    if not own_points and abs(sum(_turn(*t) for t in out) - whole) > 1e-6 * abs(area2(outer)):
        return _slabs([outer, *(h for h in inner if len(h) >= 3)])
    return out


def convex_hull(points: list[Point]) -> list[tuple[float, float]]:
    """Monotone chain, counter-clockwise; two points for a line, one for a point."""
    p = sorted({q[:2] for q in points})
    if len(p) <= 2:
        return p
    halves = []
    for side in (p, p[::-1]):
        half: list = []
        for q in side:
            while len(half) >= 2 and _turn(half[-2], half[-1], q) <= 0:
                half.pop()
            half.append(q)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def buffer_line(line: list[Point], width: float) -> list[Point]:
    """Ring of a line widened by half its width to each side, with mitred corners; 2n points, straight corners included."""
    p = opened(line)
    if len(p) < 2 or width <= 0:
        return []
    sides: tuple[list, list] = ([], [])
    units = []
    for a, b in zip(p, p[1:], strict=False):
        n = math.dist(a[:2], b[:2])
        units.append(((b[0] - a[0]) / n, (b[1] - a[1]) / n))
    for i, q in enumerate(p):
        u, v = units[max(0, i - 1)], units[min(i, len(units) - 1)]
        nx, ny = -(u[1] + v[1]), u[0] + v[0]
        size = nx * nx + ny * ny
        if size < 1e-12:  # the line turns back on itself
            nx, ny, size = -u[1], u[0], 1.0
            scale = width / 2
        else:
            scale = width / size
        for side, sign in zip(sides, (1, -1), strict=True):
            side.append((q[0] + sign * nx * scale, q[1] + sign * ny * scale, q[2]))
    return sides[0] + sides[1][::-1]


def extrude(ring: list[Point], holes: list[list[Point]], height: float, flat_roof: bool = True) -> list[tuple[Point, Point, Point]]:
    """Roof and walls over a footprint, no floor; the roof is level with the first point's height unless flat_roof is off."""
    ext = opened(ring)
    if len(ext) < 3:
        return []
    top = ext[0][2] + height
    lift = lambda q: (q[0], q[1], top if flat_roof else q[2] + height)
    out = [tuple(lift(q) for q in t) for t in triangulate(ext, holes)]
    for r in [ext, *[opened(h) for h in holes]]:
        for a, b in zip(r, [*r[1:], r[0]], strict=True):
            ua, ub = (a[0], a[1], a[2] + height), (b[0], b[1], b[2] + height)
            out += [(a, b, ub), (a, ub, ua)]
    return out


def extrude_line(line: list[Point], width: float, height: float) -> list[tuple[Point, Point, Point]]:
    """Roof of quads between the two sides of a widened line, and walls."""
    ring = buffer_line(line, width)
    n = len(ring)
    if n < 4:
        return []
    up = [(p[0], p[1], p[2] + height) for p in ring]
    out = []
    for i in range(n // 2 - 1):
        a, b, c, d = up[i], up[i + 1], up[n - 2 - i], up[n - 1 - i]
        out += [(a, b, c), (a, c, d)]
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        out += [(a, b, up[(i + 1) % n]), (a, up[(i + 1) % n], up[i])]
    return out


def block(outline: list[tuple[float, float]], low: float, high: float) -> list[tuple[Point, Point, Point]]:
    """Roof and walls from low to high over an outline; a line becomes a sliver a tenth wide."""
    if len(outline) == 2:
        (ax, ay), (bx, by) = outline
        outline = [(ax, ay), (bx, by), (bx + 0.1, by + 0.1)]
    if len(outline) < 3:
        return []
    return extrude([(x, y, low) for x, y in outline], [], high - low)


def read_wkb(data: bytes) -> list[list[list[Point]]]:
    """Polygons of a (multi)polygon or triangulated surface in well-known binary, with or without z and SRID; each a list of rings."""
    at = 0

    def take(fmt: str):
        nonlocal at
        v = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return v

    def geometry() -> list[list[list[Point]]]:
        order = "<" if take("B")[0] == 1 else ">"
        code = take(order + "I")[0]
        if code & 0x20000000:
            take(order + "I")
        z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
        kind = (code & 0xFFFF) % 1000
        if kind in (3, 17):
            rings = []
            for _ in range(take(order + "I")[0]):
                n = take(order + "I")[0]
                flat = take(f"{order}{n * (3 if z else 2)}d")
                step = 3 if z else 2
                rings.append([(flat[i], flat[i + 1], flat[i + 2] if z else 0.0) for i in range(0, len(flat), step)])
            return [rings]
        if kind in (6, 7, 15, 16):
            return [p for _ in range(take(order + "I")[0]) for p in geometry()]
        raise ValueError(f"no polygons in geometry of type {kind}")

    return geometry()


def _plane(ring: list[Point]) -> tuple[int, int]:
    """The two axes in which a ring in space has the largest area."""
    n = [0.0, 0.0, 0.0]
    o = ring[0]
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        a, b = [p[i] - o[i] for i in range(3)], [q[i] - o[i] for i in range(3)]
        for i in range(3):
            n[i] += a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3]
    most = max(range(3), key=lambda i: abs(n[i]))
    return [(1, 2), (2, 0), (0, 1)][most]


def wkb_triangles(data: bytes | None) -> list[tuple[Point, Point, Point]] | None:
    """Polygons in space as triangles: each is cut in the plane of its largest area. Damaged data gives null."""
    if data is None:
        return None
    try:
        polygons = read_wkb(bytes(data))
    except (ValueError, struct.error):
        return None
    out: list = []
    for rings in polygons:
        if not rings or len(rings[0]) < 3:
            continue
        i, j = _plane(rings[0])
        flat = lambda r, i=i, j=j: [(p[i], p[j], k) for k, p in r]
        every = [p for r in rings for p in r]
        place, start = [], 0
        for r in rings:
            place.append(flat(list(enumerate(r, start))))
            start += len(r)
        out += [tuple(every[int(q[2])] for q in t) for t in triangulate(place[0], place[1:], own_points=True)]
    return out


def rows_of(tri) -> list[dict] | None:
    name = lambda p: {"x": float(p[0]), "y": float(p[1]), "z": float(p[2])}
    return None if tri is None else [{"a": name(a), "b": name(b), "c": name(c)} for a, b, c in tri]


def points_of(ring) -> list[Point]:
    return [] if ring is None else [(p["x"], p["y"], p["z"]) for p in ring]


@F.pandas_udf(TRIANGLES_TYPE)
def triangulated(ext: pd.Series, holes: pd.Series) -> pd.Series:
    return pd.Series([rows_of(triangulate(points_of(e), [points_of(h) for h in (hs if hs is not None else [])])) for e, hs in zip(ext, holes, strict=True)])


@F.pandas_udf(TRIANGLES_TYPE)
def extruded(ext: pd.Series, holes: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([rows_of(extrude(points_of(e), [points_of(h) for h in (hs if hs is not None else [])], z)) for e, hs, z in zip(ext, holes, height, strict=True)])


@F.pandas_udf(RING_TYPE)
def buffered(line: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([[{"x": p[0], "y": p[1], "z": p[2]} for p in buffer_line(points_of(r), w)] for r, w in zip(line, width, strict=True)])


@F.pandas_udf(TRIANGLES_TYPE)
def hull_block(points: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([rows_of(block(convex_hull(points_of(p)), a, b)) for p, a, b in zip(points, low, high, strict=True)])


@F.pandas_udf(TRIANGLES_TYPE)
def outline_block(ring: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Over a given outline (struct<x,y>), as zones have it."""
    return pd.Series([rows_of(block([(p["x"], p["y"]) for p in r], a, b)) if a == a else None for r, a, b in zip(ring, low, high, strict=True)])


@F.pandas_udf(TRIANGLES_TYPE)
def from_wkb(data: pd.Series) -> pd.Series:
    return pd.Series([rows_of(wkb_triangles(d)) for d in data])
