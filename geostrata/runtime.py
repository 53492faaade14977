"""Session helpers shared by every operator: shared-folder tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side is broadcast. Beyond it the join is left to the planner and shuffles.
BROADCAST_ROWS = 100_000


def session(app: str = "geostrata", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects of a cluster."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a session; clusters that have it installed don't need this."""
    sc = spark.sparkContext
    if not getattr(sc, "_geostrata_shipped", False):
        home = Path(__file__).resolve().parent
        # the driver serves the file to the executors
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="geostrata-")) / "geostrata.zip", "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(z.filename)
        sc._geostrata_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = getattr(spark.sparkContext, "_geostrata_shared", None)
    if held is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="geostrata-")
        spark.sparkContext._geostrata_shared = held
    return held


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executor loss, is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast only when its counted size is within the bound; df should be cheap to recompute and have narrow rows."""
    return F.broadcast(df) if within(df, rows) else df


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


#: Rows of one key that one task takes in a salted join.
KEY_ROWS = 200_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", key_rows: int = KEY_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """left joined to right on equal keys. A right side of few rows is broadcast.

    Else keys with more than key_rows rows on the left are dealt out by a hash of 'spread', and their rows on the right repeated as often.
    """
    if broadcast_rows and within(right, broadcast_rows):
        return left.join(F.broadcast(right), keys, how)
    hot = left.groupBy(*keys).count().filter(F.col("count") > key_rows).select(*keys, (F.floor(F.col("count") / key_rows) + 1).cast("int").alias("_salts"))
    # at most one row for each key_rows rows of the left side
    hot = bounded(hot)
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task orders when rows are numbered.
NUMBER_ROWS = 500_000


def row_numbers(df: DataFrame, order: list[str], name: str, task_rows: int = NUMBER_ROWS) -> DataFrame:
    """Adds the row's number from 0 over the whole table; larger tables are ordered by range partitions and offsets."""
    n = df.count()
    if n <= task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    cut = stored(df.repartitionByRange(-(-n * 2 // task_rows), *order).withColumn("_part", F.spark_partition_id()))
    before = cut.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_own", own).join(bounded(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part")
