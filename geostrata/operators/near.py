"""Points near other points, and the regions around points.

Regions: SQL crossing parity. Region edges are cut into strips of equal height in y, candidate points meet the edges
of their strip, and the crossings of the ray to +x are counted by point and region; odd is inside. Points on an edge
are told apart by an exact test and are not inside. Distances and sides are computed on whole numbers of a tenth of a
millimetre, in 64 bits or, for zones beyond 100 km, in whole decimals, so nothing depends on rounding.

Near pairs: points meet in grid cells as wide as the distance, each against its own and four of the eight cells
around, so a pair comes up once. Cells with many points are split: one side is dealt out over salts, the other is
repeated on each, so no task holds a crowded cell whole.

Nulls: points without a location and regions without a ring of three different points give nothing. A null code is
equal to no other. Rings may be open or closed, run either way and repeat points. Repeated rows of one id count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.runtime import BROADCAST_ROWS, KEY_ROWS, salted_join, within

#: Whole units in a metre.
UNIT = 10_000
#: Points of a cell that one salt takes.
CELL_POINTS = 1_000
#: Border between the ranges of x and y of the plane's coordinates (metres): what tells swapped axes. Another plane needs another one.
AXIS_BORDER = 4_000_000.0


def first_part(geom_type: Column, coordinates: Column) -> Column:
    """array<array<double>> of all points of a geometry's first part (of a single geometry: of the whole)."""
    deep = F.length(F.regexp_replace(F.regexp_extract(coordinates, r"^\s*(\[[\[\s]*)", 1), r"\s", ""))
    multi = F.lower(geom_type).startswith("multi")
    nest = lambda n: F.from_json(coordinates, "array<" * n + "double" + ">" * n)
    four = nest(4)
    return (
        F.when(deep == 4, F.when(multi, F.flatten(F.try_element_at(four, F.lit(1)))).otherwise(F.flatten(F.flatten(four))))
        .when(deep == 3, F.when(multi, F.try_element_at(nest(3), F.lit(1))).otherwise(F.flatten(nest(3))))
        .when(deep == 2, F.when(multi, F.slice(nest(2), 1, 1)).otherwise(nest(2)))
        .when(deep == 1, F.array(nest(1)))
    )


def locations(features: DataFrame, axis_border: float = AXIS_BORDER) -> DataFrame:
    """(feature_id, code, x, y) in whole units: the middle of the ranges of x and y; one row per id. axis_border: a first coordinate beyond it is y."""
    pts = features.filter("feature_id is not null").select("feature_id", F.col("feature_code").alias("code"), first_part(F.col("geometry.geom_type"), F.col("geometry.coordinates")).alias("p"))
    ok = F.filter("p", lambda a: (F.size(a) >= 2) & a[0].isNotNull() & a[1].isNotNull())
    xy = F.transform(ok, lambda a: F.struct(F.when(a[0] > axis_border, a[1]).otherwise(a[0]).alias("x"), F.when(a[0] > axis_border, a[0]).otherwise(a[1]).alias("y")))
    pts = pts.select("feature_id", "code", xy.alias("p"))
    x, y = F.transform("p", lambda a: a["x"]), F.transform("p", lambda a: a["y"])
    mid = lambda a: F.round((F.array_min(a) + F.array_max(a)) / 2 * UNIT).cast("bigint")
    return pts.select("feature_id", "code", mid(x).alias("x"), mid(y).alias("y")).filter("x is not null and y is not null").groupBy("feature_id").agg(F.min(F.struct("code", "x", "y")).alias("v")).select("feature_id", "v.*")


def near_pairs(points: DataFrame, metres: float, cell_points: int = CELL_POINTS) -> DataFrame:
    """points(feature_id, code, x, y): pairs (low_id, high_id, distance) of different code less than metres apart."""
    reach = int(round(metres * UNIT))
    p = points.select("feature_id", "code", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    crowd = p.groupBy("cx", "cy").count().filter(F.col("count") > cell_points).select("cx", "cy", (F.floor(F.col("count") / cell_points) + 1).cast("int").alias("salts"))
    # one row per crowded cell, so it is small; the planner sees its size at run time
    a = p.join(crowd, ["cx", "cy"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    a = a.withColumn("salt", F.pmod(F.xxhash64("feature_id"), F.col("salts")).cast("int"))
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    b = p.select(F.col("feature_id").alias("id2"), F.col("code").alias("code2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(steps).alias("s"))
    b = b.select("id2", "code2", "x2", "y2", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    b = b.join(crowd, ["cx", "cy"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    square = dx * dx + dy * dy
    close = (square < reach * reach) & ~F.coalesce(F.col("code") == F.col("code2"), F.lit(False)) & (~F.col("own") | (F.col("feature_id") < F.col("id2")))
    pairs = a.join(b, ["cx", "cy", "salt"]).filter(close)
    return pairs.select(F.least("feature_id", "id2").alias("low_id"), F.greatest("feature_id", "id2").alias("high_id"), (F.sqrt(square.cast("double")) / UNIT).alias("distance"))


def edges(zones: DataFrame) -> DataFrame:
    """(zone_id, x1, y1, x2, y2, zone bounds) in whole units: the ring's edges, closed, without those of no length."""
    z = zones.filter("zone_id is not null and ring is not null").groupBy("zone_id").agg(F.min("ring").alias("ring"))
    ok = F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    r = F.transform(ok, lambda p: F.struct(F.round(p["x"] * UNIT).cast("bigint").alias("x"), F.round(p["y"] * UNIT).cast("bigint").alias("y")))
    z = z.select("zone_id", r.alias("r")).filter("size(r) >= 3")
    e = z.select("zone_id", F.explode(F.zip_with("r", F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"), "r")
    low, high = (lambda c: F.array_min(F.transform("r", lambda p: p[c]))), (lambda c: F.array_max(F.transform("r", lambda p: p[c])))
    return e.select("zone_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"), low("x").alias("zx1"), high("x").alias("zx2"), low("y").alias("zy1"), high("y").alias("zy2")).filter("x1 <> x2 or y1 <> y2")


#: Strips that the longer side of a zone is cut into at most; larger zones have higher strips, by powers of four.
ZONE_STRIPS = 64
#: Width of a cell along a strip, in strip heights.
CELL_STRIPS = 8


def _strips(zones: DataFrame, height: int) -> DataFrame:
    """The edges by level and strip: the strips of a level are four times as high as those of the level below."""
    e = edges(zones)
    extent = F.greatest(F.col("zx2") - F.col("zx1"), F.col("zy2") - F.col("zy1"))
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(extent / F.lit(float(height * ZONE_STRIPS)), F.lit(1.0))))).cast("int")
    e = e.withColumn("level", level).withColumn("size", (F.lit(height) * F.pow(F.lit(4.0), "level")).cast("bigint"))
    strip = lambda y: F.floor(y / F.col("size"))
    return e.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))


def _side() -> Column:
    """On which side of its edge a point lies, as the sign of a product: in 64 bits where the zone is small enough for it, else in whole decimals."""

    def product(t: str) -> Column:
        c = lambda name: F.col(name).cast(t)
        return F.signum(((c("x2") - c("x1")) * (c("y") - c("y1")) - (c("y2") - c("y1")) * (c("x") - c("x1"))).cast("double"))

    small = F.greatest(F.col("zx2") - F.col("zx1"), F.col("zy2") - F.col("zy1")) < 2**30
    return F.when(small, product("bigint")).otherwise(product("decimal(18,0)"))


def containing_zones(points: DataFrame, zones: DataFrame, strip_metres: float = 50.0, broadcast_rows: int = BROADCAST_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """(zone_id, feature_id) of each point strictly inside a ring.

    Few edges are broadcast by strip. Beyond broadcast_rows points and edges meet by strip and cell: an edge stands in
    the cells from its zone's left border to its own right end, so a point meets all edges right of it and only zones
    around its cell; crowded cells are split.
    """
    height = max(1, int(round(strip_metres * UNIT)))
    cut = _strips(zones, height)
    if within(cut, broadcast_rows):
        cut, cells = F.broadcast(cut), False
    else:
        cells = True
    # at most one level for each power of four that 64 bits hold
    levels = sorted(r.level for r in cut.select("level").distinct().collect())
    size = F.lit(height) * F.pow(F.lit(4.0), F.col("level")).cast("bigint")
    p = points.select("feature_id", "x", "y", F.explode(F.array(*[F.lit(k) for k in levels])).alias("level") if levels else F.lit(0).alias("level"))
    p = p.withColumn("strip", F.floor(F.col("y") / size))
    if cells:
        wide = F.col("size") * CELL_STRIPS
        cut = cut.withColumn("cell", F.explode(F.sequence(F.floor(F.col("zx1") / wide), F.floor(F.greatest("x1", "x2") / wide)))).drop("size")
        met = salted_join(p.withColumn("cell", F.floor(F.col("x") / (size * CELL_STRIPS))), cut, ["level", "strip", "cell"], "feature_id", key_rows=key_rows, broadcast_rows=0)
    else:
        met = p.join(cut.drop("size"), ["level", "strip"])
    # the ring's bounds keep far points out and the products within their types
    hit = (F.col("x") > F.col("zx1")) & (F.col("x") < F.col("zx2")) & (F.col("y") > F.col("zy1")) & (F.col("y") < F.col("zy2"))
    met = met.filter(hit).withColumn("side", _side())
    on_edge = (F.col("side") == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    up = (F.col("y1") <= F.col("y")) & (F.col("y2") > F.col("y"))
    down = (F.col("y2") <= F.col("y")) & (F.col("y1") > F.col("y"))
    crossing = (up & (F.col("side") > 0)) | (down & (F.col("side") < 0))
    # partial sums first: the edges a point met in one task are one row
    counted = met.groupBy("feature_id", "zone_id").agg(F.sum(crossing.cast("int")).alias("crossings"), F.max(on_edge).alias("on_edge"))
    return counted.filter("crossings % 2 = 1 and not on_edge").select("zone_id", "feature_id")
