"""Parent-child links of unknown depth into tops, depths, paths and descendants, with closed chains reported.

A weighted disjoint-set forest: every partition first joins the links it holds (find with path compression, each node
keeping its offset, the number of links, to its root). Only roots whose parent lies in another partition go on, as one
weighted link each; forests of neighbouring partitions are then merged level by level, each level with the roots that
its groups left open. What never comes to an end is on a closed chain or below one. Paths come from traversal of the
parent index: inside the partition, then along the merged links.

Nulls: a null parent is a top, a null id is no node. A parent that is no node ends the chain there (orphan). Repeated
ids must be resolved before (see latest). Ties: the smallest id names a closed chain. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.runtime import stored

#: Rows that one task takes at a time: size of a partition's forest, and bound of the links merged in one task.
TASK_ROWS = 500_000

NODE = "id bigint, parent bigint, rep bigint, links int, state string"


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """Per key the newest row; combines on the map side. Ties: the row that sorts last as a whole."""
    order = F.struct(*newest, *[c for c in rows.columns if c not in (key, *newest)])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("r")).select(key, "r.*")


def forest(ids: np.ndarray, parents: np.ndarray, has: np.ndarray, weights: np.ndarray | None = None):
    """(index of root, links to it, on a closed chain, ends outside) of sorted unique ids.

    A root is a node without a parent among ids, or the smallest id of a closed chain.
    """
    n = len(ids)
    at = np.searchsorted(ids, parents)
    at[at == n] = 0
    inner = has & (ids[at] == parents) if n else has
    up = np.where(inner, at, np.arange(n))
    step = np.where(inner, 1 if weights is None else weights, 0).astype(np.int64)
    closed = np.zeros(n, bool)

    def compress(up: np.ndarray, step: np.ndarray):
        root, links = up.copy(), step.copy()
        for _ in range(int(n).bit_length() + 1):
            if (up[root] == root).all():
                break
            links = links + links[root]
            root = root[root]
        return root, links

    root, links = compress(up, step)
    # a node that leads to itself has no step to go; a link to itself is a closed chain of one
    own = inner & (at == np.arange(n))
    endless = (up[root] != root) | own[root]
    if endless.any():
        ring = np.unique(root[endless])
        while len(new := np.setdiff1d(up[ring], ring)):
            ring = np.concatenate([ring, new])
        closed[ring] = True
        # the smallest id of each ring names it: indexes are in id order
        low, far = np.arange(n), up.copy()
        for _ in range(int(len(ring)).bit_length() + 1):
            low[ring] = np.minimum(low[ring], low[far[ring]])
            far[ring] = far[far[ring]]
        cut = np.where(closed, np.arange(n), up)
        root, links = compress(cut, np.where(closed, 0, step))
        root = np.where(closed[root], low[root], root)
    return root, links, closed, has & ~inner


def _local(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pd.concat(held, ignore_index=True).sort_values("id", ignore_index=True)
        ids, has = t["id"].to_numpy(np.int64), t["parent"].notna().to_numpy()
        parents = t["parent"].fillna(0).to_numpy(np.int64)
        root, links, closed, outside = forest(ids, parents, has)
        state = np.where(closed[root], np.where(closed, "cycle", "below_cycle"), np.where(outside[root], "open", "top"))
        out = pd.DataFrame({"id": ids, "parent": pd.array(parents, dtype="Int64"), "rep": ids[root], "links": links.astype(np.int32), "state": state})
        out.loc[~has, "parent"] = pd.NA
        if paths:
            out["path"] = _paths(ids, parents, links)
        yield out

    return run


def _paths(ids: np.ndarray, parents: np.ndarray, links: np.ndarray) -> list[list[int]]:
    """From the local root (or the first node on the closed chain) to the node, by traversal of the parent index."""
    made: dict[int, list[int]] = {}
    for k in np.argsort(links, kind="stable"):
        i = int(ids[k])
        made[i] = [i] if links[k] == 0 else [*made[int(parents[k])], i]
    return [made[int(i)] for i in ids]


def partition_forests(links: DataFrame, hint: str | None, paths: bool, task_rows: int = TASK_ROWS) -> DataFrame:
    """The forest of each partition. hint: a column that mostly keeps a tree together; hot values are split."""
    n = links.count()
    parts = max(1, -(-n // task_rows))
    if parts == 1:
        spread = links.select("id", "parent").coalesce(1)
    else:
        key = F.coalesce(F.col(hint), F.col("parent"), F.col("id")) if hint else F.col("id")
        # by ranges of the key and then of the id: a hot tree becomes several partitions of neighbouring ids
        spread = links.select("id", "parent", key.alias("key")).repartitionByRange(2 * parts, "key", "id").select("id", "parent")
    return spread.mapInPandas(_local(paths), NODE + (", path array<bigint>" if paths else ""))


def resolve(links: DataFrame, hint: str | None = None, paths: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """links(id, parent, ...) to (id, parent, top_id, links_up, fault[, path]); fault: null, orphan, cycle or below_cycle."""
    nodes = stored(partition_forests(links, hint, paths, task_rows).withColumn("part", F.spark_partition_id()))
    seg = ["seg"] if paths else []
    empty = F.array().cast("array<bigint>")
    # one weighted link for each local root whose parent lies elsewhere: to the root of the parent's own forest
    roots = nodes.filter("state = 'open' and id = rep").select(F.col("id").alias("root"), F.col("parent").alias("goal"), "part")
    target = nodes.select(F.col("id").alias("goal"), F.col("rep").alias("next"), (F.col("links") + 1).alias("w"), F.col("state").alias("next_state"), *([F.col("path").alias("seg")] if paths else []))
    merged = stored(roots.join(target, "goal", "left"))
    none, open_ = F.col("next").isNull(), F.col("next_state") == "open"
    # an orphan root is its own end; a next root that is no open one is the end
    end = F.when(none, F.col("root")).when(~open_, F.col("next"))
    fault = F.when(none, "orphan").when(F.col("next_state").isin("cycle", "below_cycle"), "below_cycle")
    state = merged.select("root", "part", F.when(open_, F.col("next")).alias("next"), end.alias("end"), fault.alias("fault"), F.when(none, 0).otherwise(F.col("w")).cast("int").alias("w"), *([F.coalesce("seg", empty).alias("seg")] if paths else []))
    state = stored(state)
    some = state.filter("next is not null").limit(1).count()
    ends = _merge(state, paths, task_rows) if some else state.select("root", "end", "w", "fault", *seg)
    out = nodes.join(ends.withColumnsRenamed({"root": "rep", "w": "more", "seg": "before"}), "rep", "left")
    fault = F.when(F.col("state") == "open", F.col("fault")).otherwise(F.when(F.col("state") != "top", F.col("state")))
    done = out.withColumn("fault", fault).select("id", "parent", F.coalesce("end", "rep").alias("top_id"), (F.col("links") + F.coalesce("more", F.lit(0))).alias("links_up"), "fault", *([F.concat(F.coalesce("before", empty), "path").alias("path")] if paths else []), (F.col("state") == "open").alias("was_open"), F.col("end").isNotNull().alias("ended"))
    settled = done.filter("ended or not was_open").drop("was_open", "ended")
    if not some:
        return settled
    # chains that close across partitions, or run into one that does: these nodes alone, link by link
    rest = done.filter("was_open and not ended").select("id", "parent")
    return settled.unionByName(_closed(rest, paths, task_rows))


def _level(paths: bool):
    """The links of a group of partitions joined: each root with the last root of its chain inside the group and the links to it."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("root", ignore_index=True)
        ids, has = t["root"].to_numpy(np.int64), t["next"].notna().to_numpy()
        goal = t["next"].fillna(0).to_numpy(np.int64)
        root, links, closed, _ = forest(ids, goal, has, t["w"].to_numpy(np.int64))
        out = pd.DataFrame({"root": ids, "rep": ids[root], "acc": links.astype(np.int32), "endless": closed[root]})
        if paths:
            made: dict[int, list] = {}
            segs = t["seg"].tolist()
            inner = dict(zip(ids.tolist(), range(len(ids)), strict=True))
            for k in np.argsort(links, kind="stable"):
                above = made.get(int(goal[k])) if root[k] != k and not closed[root[k]] and int(goal[k]) in inner else None
                made[int(ids[k])] = [] if above is None else [*above, *segs[k]]
            out["way"] = [made[i] for i in ids.tolist()]
        return out

    return run


def _merge(state: DataFrame, paths: bool, task_rows: int) -> DataFrame:
    """state(root, part, next, end, fault, w[, seg]) to (root, end, w, fault[, seg]) of the roots that end.

    Groups of neighbouring partitions are joined into one, level by level, and each level hands on the last roots of its
    groups only. Where a level joins too little (chains that leave every group at once), a round of doubling comes between.
    """
    seg = ["seg"] if paths else []
    known = stored(state.filter("end is not null").select("root", "end", "w", "fault", *seg))
    ways: list[DataFrame] = []
    # roots that have an end stand for it: they lead nowhere
    t = stored(state.select("root", "part", "next", F.when(F.col("next").isNull(), 0).otherwise(F.col("w")).alias("w"), *([F.when(F.col("next").isNull(), F.array().cast("array<bigint>")).otherwise(F.col("seg")).alias("seg")] if paths else [])))
    n, parts = t.filter("next is not null").count(), t.agg(F.max("part")).first()[0] + 1
    schema = "root bigint, rep bigint, acc int, endless boolean" + (", way array<bigint>" if paths else "")
    level = 0
    while n:
        groups = -(-2 * n // task_rows) if n > task_rows else 1
        own = t.withColumn("group", F.floor(F.col("part") * groups / parts))
        joined = stored(own.groupBy("group").applyInPandas(_level(paths), schema))
        ways.append(joined.filter("rep <> root and not endless"))
        if groups == 1:
            break
        t, left, level = *_next_level(t, joined, paths), level + 1
        if left > 0.8 * n:
            t, way = _doubled(t, paths, level)
            ways.append(way)
        n = left
    for way in reversed(ways):
        e = known.select(F.col("root").alias("rep"), "end", "w", "fault", *seg)
        more = way.join(e, "rep").select("root", "end", (F.col("acc") + F.col("w")).alias("w"), "fault", *([F.concat("seg", "way").alias("seg")] if paths else []))
        known = stored(known.unionByName(more))
    return known


def _next_level(t: DataFrame, joined: DataFrame, paths: bool) -> tuple[DataFrame, int]:
    """The last roots of the groups, each with the last root of the group its link leads into, and their number; those that never end are left out, and ends that no link leads to."""
    tops = t.join(joined.filter("rep = root and not endless").select("root"), "root")
    goal = joined.select(F.col("root").alias("next"), F.col("rep").alias("next2"), "acc", "endless", *(["way"] if paths else []))
    out = tops.join(goal, "next", "left").filter("endless is null or not endless")
    out = stored(out.select("root", "part", F.col("next2").alias("next"), (F.col("w") + F.coalesce("acc", F.lit(0))).alias("w"), *([F.concat(F.coalesce("way", F.array().cast("array<bigint>")), "seg").alias("seg")] if paths else [])))
    going = out.filter("next is not null")
    n = going.count()
    needed = going.select(F.col("next").alias("root")).distinct()
    return stored(going.unionByName(out.filter("next is null").join(needed, "root", "left_semi").select(*going.columns))), n


def _doubled(t: DataFrame, paths: bool, level: int) -> tuple[DataFrame, DataFrame]:
    """A round of weighted pointer doubling: every second root of a chain is passed over. (the roots that stay, ways of those passed over)"""
    # a root is passed over when it and its next draw (1, 0): no two neighbours are, and about a quarter of all
    draw = lambda c: F.xxhash64(F.lit(level), c) % 2 == 0
    way = t.filter("next is not null").filter(draw("root") & ~draw("next"))
    way = stored(way.select("root", F.col("next").alias("rep"), F.col("w").alias("acc"), *([F.col("seg").alias("way")] if paths else [])))
    goal = way.select(F.col("root").alias("next"), F.col("rep").alias("next2"), "acc", *(["way"] if paths else []))
    stay = t.join(way.select("root"), "root", "left_anti").join(goal, "next", "left")
    return stored(stay.select("root", "part", F.coalesce("next2", "next").alias("next"), (F.col("w") + F.coalesce("acc", F.lit(0))).alias("w"), *([F.concat(F.coalesce("way", F.array().cast("array<bigint>")), "seg").alias("seg")] if paths else []))), way


def _closed(rest: DataFrame, paths: bool, task_rows: int) -> DataFrame:
    """Nodes none of whose chains ends: on a closed chain or below one."""
    rest = stored(rest)
    n = rest.count()
    columns = "id bigint, parent bigint, top_id bigint, links_up int, fault string" + (", path array<bigint>" if paths else "")
    if n <= task_rows:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in _local(paths)(batches):
                yield t.rename(columns={"rep": "top_id", "links": "links_up", "state": "fault"})

        return rest.coalesce(1).mapInPandas(run, columns)
    # doubling until the set of nodes landed on no longer shrinks and the smallest id seen no longer falls:
    # then the nodes landed on are the closed chains, and each of them has seen all of its own
    jump = rest.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low"))
    before = None
    while True:
        j = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        now = jump.join(jump.select(F.col("to").alias("id")).distinct(), "id").agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        jump = stored(jump.join(j, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    ring = stored(jump.select(F.col("to").alias("id")).distinct().join(jump.select("id", "low"), "id").select("id", "low"))
    up = rest.join(ring, "id", "left").select("id", "parent", "low")
    cut = up.select("id", F.when(F.col("low").isNull(), F.col("parent")).alias("parent"))
    below = resolve(cut, None, paths, task_rows)
    named = below.join(ring.select(F.col("id").alias("top_id"), "low"), "top_id")
    out = named.join(rest.withColumnRenamed("parent", "own"), "id").select("id", F.col("own").alias("parent"), F.col("low").alias("top_id"), "links_up", F.when(F.col("links_up") == 0, "cycle").otherwise("below_cycle").alias("fault"), *(["path"] if paths else []))
    return out


def closure(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node and every ancestor, itself at distance 0, from the paths."""
    p = resolved.select("id", "path", F.posexplode("path").alias("k", "ancestor_id"))
    return p.select("ancestor_id", F.col("id").alias("node_id"), (F.size("path") - 1 - F.col("k")).alias("distance"))


def buildings(building: DataFrame) -> DataFrame:
    """(id, parent, root): per id the row modified last."""
    b = building.select("id", "last_modified_at", "loaded_at", "building_parent_id", "building_root_id")
    return latest(b, "id", "last_modified_at", "loaded_at").select("id", F.col("building_parent_id").alias("parent"), F.col("building_root_id").alias("root"))


def tileset_links(tilesets: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, parent): the tileset whose tiles name this one's tileset.json. Named twice: the smaller id."""
    own = tilesets.filter("tileset_id is not null").groupBy(F.col("tileset_id").alias("id")).agg(F.min("dir_name").alias("dir_name"))
    name = F.regexp_extract("content_uri", r"(?:^|/)([^/]+)/tileset\.json(?:[?#].*)?$", 1)
    named = contents.select(F.col("record_id").alias("parent"), name.alias("dir_name")).filter("dir_name <> ''").groupBy("dir_name").agg(F.min("parent").alias("parent"))
    return own.join(named, "dir_name", "left").select("id", "parent")
