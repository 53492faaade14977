"""Feature views over the test tables, in text that both engines read; in Spark they are DataFrames with nested geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.functions import geometry as G
from geostrata.runtime import read

TEXT = {
    "v_points": "SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR(20)) AS id, c_acctbal AS x, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS y, CAST(c_nationkey AS DOUBLE) AS z, c_mktsegment AS klass FROM customer",
    "v_foot": "SELECT p_partkey AS id, CAST(p_partkey % 100 AS DOUBLE) * 20 AS gx, CAST(floor(p_partkey / 100) AS DOUBLE) * 20 AS gy, CAST(p_size AS DOUBLE) AS w, CAST(floor(p_size / 2) AS DOUBLE) + 1 AS d, CAST(p_size % 7 AS DOUBLE) AS z, p_retailprice / 100 AS height FROM part",
    "v_zones": "SELECT n_nationkey AS zone_id, CAST(n_nationkey % 5 AS DOUBLE) * 2200 + 100 AS cx, CAST(floor(n_nationkey / 5) AS DOUBLE) * 2000 + 1000 AS cy, CAST(1500 AS DOUBLE) AS r FROM nation",
    "v_visits": "SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS INT) AS ts FROM orders",
    "v_steps": "SELECT c, ts, lead(ts) OVER (PARTITION BY c ORDER BY ts) AS nxt, c - c % 2 AS pair, CAST(floor(c / 2) AS BIGINT) % 5 AS k FROM v_visits",
    "v_edges": """SELECT c * 10000 + ts AS edge_id,
        CASE WHEN k = 4 THEN concat(ts, '::', pair) ELSE concat(ts, '::', c) END AS src, CASE WHEN k = 3 THEN concat(nxt, '::', pair) ELSE concat(nxt, '::', c) END AS dst, 'replace' AS type,
        CASE k WHEN 0 THEN 'unchanged' WHEN 1 THEN 're_ided' WHEN 2 THEN 'modified' WHEN 3 THEN 'fused' ELSE 'subdivided' END AS tag
        FROM v_steps WHERE nxt IS NOT NULL""",
    "v_ids": "SELECT concat(ts, '::', c) AS globalid FROM v_visits UNION SELECT src FROM v_edges UNION SELECT dst FROM v_edges",
    "v_surface": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS building_id, min(l_returnflag) AS flag, CAST(min(l_partkey) AS DOUBLE) AS x0, CAST(min(l_suppkey) AS DOUBLE) AS y0, min(l_quantity) AS w, CAST(min(l_linenumber) AS DOUBLE) AS h FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "v_building": "SELECT o_orderkey AS id, o_orderkey - o_orderkey % 3 AS building_root_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 3 END AS building_parent_id, CAST(25 + o_orderkey % 2 AS INT) AS objectclass_id, concat('BLD_', o_orderkey) AS gmlid FROM orders",
}
NEEDS = {"v_steps": ["v_visits"], "v_edges": ["v_visits", "v_steps"], "v_ids": ["v_visits", "v_steps", "v_edges"]}


def ctes(*names: str) -> str:
    """The views as the head of an oracle's text."""
    every = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({TEXT[n]})" for n in every)


TABLE_OF = {"v_points": "customer", "v_foot": "part", "v_zones": "nation", "v_visits": "orders", "v_surface": "lineitem", "v_building": "orders"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view as a DataFrame."""
    names = [*NEEDS.get(name, []), name]
    frames = {}
    for n in names:
        t = TABLE_OF.get(n)
        if t and t not in frames:
            frames[t] = read(spark, sf_dir, t)
        body = TEXT[n]
        frames[n] = spark.sql(_bound(body, frames), **{k: v for k, v in frames.items() if "{" + k + "}" in _bound(body, frames)})
    return frames[name]


def _bound(text: str, frames: dict) -> str:
    words = text.split(" ")
    return " ".join("{" + w + "}" if w in frames and k and words[k - 1] == "FROM" else w for k, w in enumerate(words))


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tri): seven triangles out of the first 63 numbers of each vector, rounded to thousandths."""
    e = read(spark, sf_dir, "embeddings")
    n = lambda i: F.round(F.element_at("embedding", i.cast("int")).cast("double"), 3)
    p = lambda k, c: G.point(n(k * 9 + c * 3 + 1), n(k * 9 + c * 3 + 2), n(k * 9 + c * 3 + 3))
    tri = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(p(k, 0).alias("a"), p(k, 1).alias("b"), p(k, 2).alias("c")))
    return e.select(F.col("vec_id").alias("id"), tri.alias("tri"))


SOUP = """soup AS (
  SELECT vec_id AS id, CAST(floor(k / 9) AS INT) AS tri_no, CAST(floor(k % 9 / 3) AS INT) AS corner, k % 3 AS axis, round(CAST(embedding[k + 1] AS DOUBLE), 3) + 0.0 AS v
  FROM embeddings, (SELECT unnest(range(63)) AS k)),
verts AS (SELECT id, tri_no, corner, max(CASE axis WHEN 0 THEN v END) AS x, max(CASE axis WHEN 1 THEN v END) AS y, max(CASE axis WHEN 2 THEN v END) AS z FROM soup GROUP BY 1, 2, 3)"""


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """The geometry as vertices: (keys, tri_no, corner, x, y, z)."""
    t = df.select(*keys, F.posexplode("tri").alias("tri_no", "t"))
    return t.select(*keys, "tri_no", F.posexplode(F.array("t.a", "t.b", "t.c")).alias("corner", "p")).select(*keys, "tri_no", "corner", "p.*")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring, height): rectangles as open counter-clockwise rings."""
    f = view(spark, sf_dir, "v_foot")
    at = lambda x, y: G.point(F.col("gx") + x, F.col("gy") + y, F.col("z"))
    ring = F.array(at(F.lit(0.0), F.lit(0.0)), at(F.col("w"), F.lit(0.0)), at(F.col("w"), F.col("d")), at(F.lit(0.0), F.col("d")))
    return f.select("id", ring.alias("ring"), "height")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, ring): diamonds."""
    z = view(spark, sf_dir, "v_zones")
    at = lambda dx, dy: F.struct((F.col("cx") + dx * F.col("r")).alias("x"), (F.col("cy") + dy * F.col("r")).alias("y"))
    return z.select("zone_id", F.array(at(1, 0), at(0, 1), at(-1, 0), at(0, -1)).alias("ring"))


def surfaces(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """City-model tables: buildings of orders, surfaces of line items."""
    s = view(spark, sf_dir, "v_surface")
    b = view(spark, sf_dir, "v_building")
    at = lambda x, y: G.point(F.col("x0") + x, F.col("y0") + y, F.col("h"))
    a, c = at(F.lit(0.0), F.lit(0.0)), at(F.col("w"), F.col("h"))
    tri = F.array(F.struct(a.alias("a"), at(F.col("w"), F.lit(0.0)).alias("b"), c.alias("c")), F.struct(a.alias("a"), c.alias("b"), at(F.lit(0.0), F.col("h")).alias("c")))
    klass = F.when(F.col("flag") == "A", 33).when(F.col("flag") == "N", 34).otherwise(35)
    return {
        "surface_geometry": s.select((F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("root_id"), tri.alias("tri")),
        "thematic_surface": s.select("id", "building_id", F.col("id").alias("lod2_multi_surface_id"), klass.alias("objectclass_id")),
        "building": b,
        "cityobject": b.select("id", "gmlid", "objectclass_id").unionByName(s.select("id", F.concat(F.lit("SRF_"), F.col("id")).alias("gmlid"), klass.alias("objectclass_id")).withColumn("id", F.col("id") + 2_000_000_000)),
        "objectclass": read(spark, sf_dir, "objectclass"),
    }
