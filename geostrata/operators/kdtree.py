"""Two-dimensional kd-tree: features into cells of near equal count.

A cell is halved by rank along x and y in turn (ties: at the first level the input order, below it the other axis,
then the input order) as long as a half would hold more than the maximum. Sizes depend on the count alone, so each
level is one ranking of slim rows (key, coordinates, order). While cells are larger than a task they are ranked by
range partitions and offsets, one row a partition and cell; all levels below that are worked out cell by cell, each
cell in one task, after a single shuffle.

Nulls: a row with a null coordinate sorts first. Repeated rows are told apart by the input order. Empty: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.runtime import bounded, row_numbers, stored

#: Rows of a cell that a single task orders.
WINDOW_ROWS = 500_000
DEFAULT_MAX = 500


def levels(n: int, most: int) -> int:
    """Levels of halving a set of n needs."""
    if n <= 0:
        return 0
    half = n - n // 2
    return 1 + (levels(half, most) if half > most else 0)


def _ranked(df: DataFrame, order: list[str], largest: int, window_rows: int) -> DataFrame:
    """Adds 'rank', from 1, within each path, by range partitions and offsets."""
    parts = max(2, -(-largest * 2 // window_rows))
    cut = stored(df.repartitionByRange(parts, "path", *order).withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy("path", "part").count()
    before = sizes.select("path", "part", (F.sum("count").over(Window.partitionBy("path").orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("path", "part").orderBy(*order))
    return cut.withColumn("own", own).join(bounded(before), ["path", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part")


def _finished(most: int):
    """All levels that are left of a cell that one task holds."""

    def run(t: pa.Table) -> pa.Table:
        ord_ = t.column("ord").to_numpy()
        # a null sorts first
        x, y = (pc.fill_null(t.column(c), float("-inf")).to_numpy() for c in "xy")
        start = t.column("path")[0].as_py()
        out = np.empty(t.num_rows, object)
        todo = [(np.arange(t.num_rows), start)]
        while todo:
            rows, path = todo.pop()
            depth, low = len(path), len(rows) // 2
            axis, other = (x, y) if depth % 2 == 0 else (y, x)
            rows = rows[np.lexsort((ord_[rows], axis[rows]) if depth == 0 else (ord_[rows], other[rows], axis[rows]))]
            for part, end in ((rows[:low], "0"), (rows[low:], "1")):
                if len(rows) - low > most:
                    todo.append((part, path + end))
                else:
                    out[part] = path + end
        return pa.table({"ord": t.column("ord"), "x": t.column("x"), "y": t.column("y"), "path": pa.array(out, pa.string())})

    return run


def cells(points: DataFrame, most: int = DEFAULT_MAX, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """points(ord, x, y) to (ord, x, y, path); paths in text order are the cells in tree order."""
    if most <= 0:
        raise ValueError("the maximum of a cell must be above 0")
    p = points.select("ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = p.schema.add("path", "string")
    n = p.count()
    p = p.select("*", F.lit("").alias("path"), F.lit(n).cast("bigint").alias("size"), F.lit(True).alias("open"))
    largest = n
    for depth in range(levels(n, most)):
        done = p.filter("not open") if depth else None
        p = p.filter("open") if depth else p
        if largest <= window_rows:  # what is left of every cell is one task's work, in one shuffle
            p = p.select("ord", "x", "y", "path").groupBy("path").applyInArrow(_finished(most), schema)
            return p if done is None else p.unionByName(done.select("ord", "x", "y", "path"))
        order = ["x", "ord"] if depth == 0 else ["x", "y", "ord"] if depth % 2 == 0 else ["y", "x", "ord"]
        r = _ranked(p, order, largest, window_rows)
        low = F.floor(F.col("size") / 2)
        right = F.col("rank") > low
        r = r.select("ord", "x", "y", F.concat("path", F.when(right, "1").otherwise("0")).alias("path"), F.when(right, F.col("size") - low).otherwise(low).alias("size"), (F.col("size") - low > most).alias("open"))
        p = stored(r if done is None else r.unionByName(done))
        largest = largest - largest // 2
    return p.select("ord", "x", "y", "path")


def numbered(cut: DataFrame) -> DataFrame:
    """Adds 'tile', the cell's number from 0 in tree order."""
    paths = cut.groupBy("path").count().select("path")
    return cut.join(row_numbers(paths, ["path"], "tile"), "path")


def kd_tree(features: DataFrame, most: int = DEFAULT_MAX, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """features(ord, x, y, ...) with 'tile'; the wide columns are joined back last, so no level shuffles them."""
    slim = numbered(cells(features, most, window_rows)).select("ord", "tile")
    return features.join(slim, "ord")
