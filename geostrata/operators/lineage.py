"""Lineage between dated snapshots: graphs of vertices 'time::local id' and tagged edges, simplified and read as transactions.

Edges are a set: a pair of vertices has one edge, the first by number. Simplification follows the time stamps, of
which there are few, so its loops are over time stamps (or halve chains), never over rows. Nulls: edges with a null
end and vertices with a null id are dropped; null tags count as unknown. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.runtime import stored

#: Snapshots of a graph; each is a round of the collapses.
MAX_STAMPS = 10_000
VERTEX = ["globalid", "ts", "local_id", "start_date", "end_date"]


def has_tag(tag: str) -> Column:
    return F.coalesce((F.col("type") == "replace") & F.array_contains("tags", tag), F.lit(False))


def vertices_of(raw: DataFrame) -> DataFrame:
    """raw(globalid) to vertices with time stamp, local id and a lifetime of that time stamp."""
    parts = F.split("globalid", "::")
    ts = parts[0].cast("int")
    return raw.filter("globalid is not null").select("globalid", ts.alias("ts"), parts[1].alias("local_id"), ts.alias("start_date"), ts.alias("end_date")).dropDuplicates(["globalid"])


def union(vertices: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of several: equal global ids are one vertex; edges are renumbered and kept once for each pair."""
    v, e = vertices[0], edges[0].withColumn("_g", F.lit(0))
    for k, (more_v, more_e) in enumerate(zip(vertices[1:], edges[1:], strict=True), 1):
        v, e = v.unionByName(more_v), e.unionByName(more_e.withColumn("_g", F.lit(k)))
    e = distinct_edges(e.withColumn("edge_id", F.struct("_g", "edge_id")).drop("_g"))
    return v.dropDuplicates(["globalid"]), e


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each pair of vertices; combines on the map side."""
    e = edges.filter("src is not null and dst is not null")
    return e.groupBy("src", "dst").agg(F.min(F.struct("edge_id", "type", "tags")).alias("e")).select("e.edge_id", "src", "dst", "e.type", "e.tags")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with in-degree, out-degree and status: hapax, start, end or link."""
    i = edges.groupBy(F.col("dst").alias("globalid")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy(F.col("src").alias("globalid")).agg(F.count("*").alias("n_out"))
    v = vertices.join(i, "globalid", "left").join(o, "globalid", "left").fillna(0, ["n_in", "n_out"])
    status = F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "hapax").when(F.col("n_in") == 0, "start").when(F.col("n_out") == 0, "end").otherwise("link")
    return v.withColumn("status", status)


def with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the out-degree of their source and the in-degree of their target."""
    o = edges.groupBy("src").agg(F.count("*").alias("src_out"))
    i = edges.groupBy("dst").agg(F.count("*").alias("dst_in"))
    return edges.join(o, "src").join(i, "dst")


def edge_counts(edges: DataFrame) -> DataFrame:
    """How many edges are one-to-one and how many carry each tag."""
    e = with_degrees(edges)
    one = (F.col("src_out") == 1) & (F.col("dst_in") == 1)
    return e.agg(
        F.count("*").alias("n_edges"), F.count_if(one).alias("n_one_to_one"),
        *[F.count_if(has_tag(t)).alias(f"n_{t}") for t in ("unchanged", "re_ided", "modified", "fused", "subdivided")],
        *[F.count_if(has_tag(t) & one).alias(f"n_{t}_one") for t in ("unchanged", "re_ided", "modified")],
    )


def contract(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One-to-one edges tagged unchanged or re_ided vanish: the newest vertex of a chain stays and starts when the oldest did.

    Chains are followed by pointer doubling.
    """
    e = with_degrees(edges)
    e = e.filter((F.col("src_out") == 1) & (F.col("dst_in") == 1) & (has_tag("unchanged") | has_tag("re_ided"))).select("src", "dst")
    jump = stored(e.select(F.col("src").alias("old"), F.col("dst").alias("new")))
    while True:
        far = jump.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        nxt = stored(jump.join(far, "new", "left").select("old", F.coalesce("newer", "new").alias("new"), F.col("newer").isNotNull().alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        jump = nxt.drop("moved")
        if not moved:
            break
    start = vertices.select(F.col("globalid").alias("old"), F.col("start_date").alias("old_start")).join(jump, "old").groupBy(F.col("new").alias("globalid")).agg(F.min("old_start").alias("chain_start"))
    v = vertices.join(jump.select(F.col("old").alias("globalid")), "globalid", "left_anti").join(start, "globalid", "left")
    v = v.select("globalid", "ts", "local_id", F.least("start_date", F.coalesce("chain_start", "start_date")).alias("start_date"), "end_date")
    k = lambda c: jump.select(F.col("old").alias(c), F.col("new").alias(c + "_new"))
    kept = edges.join(e, ["src", "dst"], "left_anti").join(k("src"), "src", "left").join(k("dst"), "dst", "left")
    kept = kept.select("edge_id", F.coalesce("src_new", "src").alias("src"), F.coalesce("dst_new", "dst").alias("dst"), "type", "tags")
    return v, distinct_edges(kept)


def stamps(vertices: DataFrame) -> list[int]:
    """The time stamps: one a snapshot, so they are few."""
    rows = vertices.select("ts").distinct().orderBy("ts").limit(MAX_STAMPS + 1).collect()
    if len(rows) > MAX_STAMPS:
        raise ValueError(f"more than {MAX_STAMPS} time stamps")
    return [r.ts for r in rows]


def collapse_fusions(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex all of whose two or more ancestors fused into it and lived at the same time takes their start; they vanish."""
    for ts in stamps(vertices):
        # the edges into this time stamp alone; the rest of the graph isn't joined
        a = vertices.select(F.col("globalid").alias("src"), "start_date", "end_date")
        here = vertices.filter(F.col("ts") == ts).select(F.col("globalid").alias("dst"))
        g = edges.join(here, "dst").join(a, "src").groupBy("dst").agg(
            F.count("*").alias("n"), F.min(has_tag("fused").cast("int")).alias("fused"), F.min("start_date").alias("s0"), F.max("start_date").alias("s1"), F.min("end_date").alias("e0"), F.max("end_date").alias("e1")
        )
        g = stored(g.filter("n >= 2 and fused = 1 and s0 = s1 and e0 = e1").select("dst", F.col("s0").alias("new_start")))
        if not g.limit(1).count():
            continue
        gone = stored(edges.join(g, "dst", "left_semi").select(F.col("src").alias("globalid")).distinct())
        vertices = vertices.join(gone, "globalid", "left_anti").join(g.withColumnRenamed("dst", "globalid"), "globalid", "left").withColumn("start_date", F.coalesce("new_start", "start_date")).drop("new_start")
        edges = edges.join(gone.withColumnRenamed("globalid", "src"), "src", "left_anti").join(gone.withColumnRenamed("globalid", "dst"), "dst", "left_anti").select("edge_id", "src", "dst", "type", "tags")
        vertices, edges = stored(vertices.select(*VERTEX)), stored(edges)
    return vertices, edges


def collapse_subdivisions(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A vertex all of whose two or more descendants are parts of it with equal dates hands them its start and vanishes.

    With one ancestor, reached by a modified edge, the parts become modified descendants of that; with more it stays.
    """
    for ts in stamps(vertices):
        d = vertices.select(F.col("globalid").alias("dst"), "start_date", "end_date")
        here = vertices.filter(F.col("ts") == ts).select(F.col("globalid").alias("src"), F.col("start_date").alias("own_start"))
        g = edges.join(here, "src").join(d, "dst").groupBy("src", "own_start").agg(
            F.count("*").alias("n"), F.min(has_tag("subdivided").cast("int")).alias("parts"), F.min("start_date").alias("s0"), F.max("start_date").alias("s1"), F.min("end_date").alias("e0"), F.max("end_date").alias("e1")
        )
        g = g.filter("n >= 2 and parts = 1 and s0 = s1 and e0 = e1").select("src", "own_start")
        up = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n_up"), F.min("src").alias("ancestor"), F.min(has_tag("modified").cast("int")).alias("modified"))
        g = stored(g.join(up, "src", "left").filter("n_up is null or (n_up = 1 and modified = 1)").select("src", "own_start", "ancestor"))
        if not g.limit(1).count():
            continue
        gone = g.select(F.col("src").alias("globalid"))
        handed = edges.join(g, "src").groupBy(F.col("dst").alias("globalid")).agg(F.min("own_start").alias("new_start"))
        vertices2 = vertices.join(gone, "globalid", "left_anti").join(handed, "globalid", "left").withColumn("start_date", F.coalesce("new_start", "start_date")).select(*VERTEX)
        moved = edges.join(g.filter("ancestor is not null"), "src").select("edge_id", F.col("ancestor").alias("src"), "dst", "type", F.array(F.lit("modified")).alias("tags"))
        rest = edges.join(gone.withColumnRenamed("globalid", "src"), "src", "left_anti").join(gone.withColumnRenamed("globalid", "dst"), "dst", "left_anti").select("edge_id", "src", "dst", "type", "tags")
        vertices, edges = stored(vertices2), stored(distinct_edges(rest.unionByName(moved)))
    return vertices, edges


def simplify(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicate edges, then chains, then fusions, then subdivisions."""
    v, e = contract(vertices, distinct_edges(edges))
    v, e = collapse_fusions(stored(v), stored(e))
    return collapse_subdivisions(v, e)


def requalified(edges: DataFrame) -> DataFrame:
    """Edges where two or more, all modified, meet are fusions, too; where they part, subdivisions, too."""
    m = has_tag("modified").cast("int")
    i = edges.groupBy("dst").agg(F.count("*").alias("n_in"), F.min(m).alias("all_in"))
    o = edges.groupBy("src").agg(F.count("*").alias("n_out"), F.min(m).alias("all_out"))
    add = lambda c, tag: F.when(c, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>"))
    e = edges.join(i, "dst").join(o, "src")
    tags = F.array_distinct(F.concat("tags", add((F.col("n_in") >= 2) & (F.col("all_in") == 1), "fused"), add((F.col("n_out") >= 2) & (F.col("all_out") == 1), "subdivided")))
    return e.select("edge_id", "src", "dst", "type", tags.alias("tags"))


def transactions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, start_date, end_date, source, destination, aggregate): modifications, then unions and divisions.

    A union or division that holds a modified edge is an aggregate of both.
    """
    d = with_degrees(edges)
    old = vertices.select(F.col("globalid").alias("src"), F.col("end_date").alias("from_date"))
    new = vertices.select(F.col("globalid").alias("dst"), F.col("start_date").alias("to_date"))
    m = d.filter(has_tag("modified") & (F.col("src_out") == 1) & (F.col("dst_in") == 1)).join(old, "src").join(new, "dst")
    m = m.select(F.lit("modification").alias("kind"), F.col("from_date").alias("start_date"), F.col("to_date").alias("end_date"), F.array("src").alias("source"), F.array("dst").alias("destination"), F.lit(False).alias("aggregate"))
    q = requalified(edges).join(old, "src").join(new, "dst")

    def many(key: str, other: str, tag: str, kind: str) -> DataFrame:
        g = q.groupBy(key).agg(F.count("*").alias("n"), F.min(has_tag(tag).cast("int")).alias("every"), F.max(has_tag("modified").cast("int")).alias("mod"), F.sort_array(F.collect_list(other)).alias("others"), F.min("from_date").alias("start_date"), F.max("to_date").alias("end_date"))
        own, others = F.array(key), F.col("others")
        return g.filter("n >= 2 and every = 1").select(F.lit(kind).alias("kind"), "start_date", "end_date", (others if key == "dst" else own).alias("source"), (own if key == "dst" else others).alias("destination"), (F.col("mod") == 1).alias("aggregate"))

    return m.unionByName(many("dst", "src", "fused", "union")).unionByName(many("src", "dst", "subdivided", "division"))


def alive(features: DataFrame, at: int) -> DataFrame:
    """Features whose lifetime holds a time."""
    return features.filter((F.col("start_date") <= at) & (F.col("end_date") >= at))


def bounds(features: DataFrame, tile: str) -> DataFrame:
    """First start and last end by tile."""
    return features.groupBy(tile).agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))


def joined_buildings(vertices: DataFrame, buildings: DataFrame) -> DataFrame:
    """Vertices with their building of the snapshot: buildings(ts, gmlid, id)."""
    return vertices.join(buildings.select("ts", F.col("gmlid").alias("local_id"), "id"), ["ts", "local_id"])


def lookup(vertices: DataFrame, globalids: DataFrame) -> DataFrame:
    """Vertices of the ids asked for; an id that two vertices have is an error, raised where its row is read."""
    n = vertices.groupBy("globalid").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in vertices.columns if c != "globalid"])
    one = n.withColumn("globalid", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one vertex "), F.col("globalid")))).otherwise(F.col("globalid"))).drop("n")
    return globalids.select("globalid").distinct().join(one, "globalid")


def listing(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of text for each vertex and edge: (kind, line)."""
    v = vertices.select(F.lit("vertex").alias("kind"), F.format_string("%s from %d to %d", "globalid", "start_date", "end_date").alias("line"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat(F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(" "), F.coalesce("type", F.lit("")), F.lit(" "), F.coalesce(F.array_join("tags", ","), F.lit(""))).alias("line"))
    return v.unionByName(e)


def missing_stamps(vertices: DataFrame, named: list[int]) -> list[int]:
    """Time stamps of the graph that weren't named."""
    return [t for t in stamps(vertices) if t not in set(named)]
