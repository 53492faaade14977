import datetime as dt

from pyspark.sql import functions as F

from geostrata.streaming import live

ROWS = [(1, 0.0, 1), (1, 9.0, 2), (2, 5.0, 3), (None, 7.0, 90)]


def source(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, x, t0 + dt.timedelta(minutes=m)) for t, x, m in ROWS], "tile int, x double, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return s.withColumn("box", F.struct(*[F.col("x").alias(k + n) for n in ("min", "max") for k in "xyz"]))


def test_running_boxes(spark, tmp_path):
    q = live.tile_boxes(source(spark, tmp_path)).writeStream.format("memory").queryName("boxes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.tile or 0, r.xmin, r.xmax, r.n_features) for r in spark.table("boxes").collect()) == [(0, 7.0, 7.0, 1), (1, 0.0, 9.0, 2), (2, 5.0, 5.0, 1)]


def test_windows_and_batches(spark, tmp_path):
    seen = []
    s = source(spark, tmp_path)
    live.on_batches(s, lambda df, k: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == 4
    q = live.tile_boxes(s, "1 minute", "1 hour").writeStream.format("memory").queryName("windows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").select("window.start").distinct().count() == 2
