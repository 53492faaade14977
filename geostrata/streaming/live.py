"""Tiles over a stream of features: boxes and lifetimes that follow late rows, and tilesets rewritten per batch.

A feature stream has (tile, box, ts[, start_date, end_date]). Rows later than the watermark are dropped by the engine,
as it states; a null tile is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geostrata.operators import grouping


def tile_boxes(stream: DataFrame, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """Running union of boxes by tile, or by tile and window of 'ts'."""
    s = stream.withWatermark("ts", late)
    if window is None:
        return grouping.tile_boxes(s)
    s = s.withColumn("window", F.window("ts", window))
    ends = [f(F.col("box")[k + n]).alias(k + n) for n, f in (("min", F.min), ("max", F.max)) for k in ("x", "y", "z")]
    return s.groupBy("window", "tile").agg(*ends, F.count("*").alias("n_features"))


def on_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hands each batch to a writer (a tileset sink is idempotent by tile number, so a batch that runs twice does no harm)."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
