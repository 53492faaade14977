"""Missing measures and categories taken from similar records, each filled value marked with how and from how far.

Time-ordered filling per entity: numbers are interpolated between the observed neighbours in time, or carried within
the gap limit; categories are carried within the gap limit. What an entity can't give comes from its group, from the
narrowest group that has a value: kind, place and vintage; kind and place; kind and vintage; kind. An entity may hold
any share of the rows: a large one is cut into parts of bounded size in time order, and what its parts carry to each
other is worked out from one summary row a part. All of it runs as column expressions and windows.

Nulls: a null entity key makes the row an entity of its own; a row without a time comes first; a field that no record
has gives method 'none' and null. Ties in time are in order of the row id. Repeated rows count as observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.functions import measures as M
from geostrata.runtime import bounded, salted_join, stored

#: Rows of one entity and field that one task orders.
PART_ROWS = 250_000
#: Days over which a value is carried; interpolation has both neighbours and no limit.
GAP_DAYS = 3 * 366.0

# The fields of each layer and what counts as usable (metres).
FIELDS = [("BATIMENT", "HAUTEUR", 2, 120), ("TRONCON_ROUTE", "LARGEUR", 1.5, 40), ("BATIMENT", "NATURE", None, None), ("TRONCON_ROUTE", "IMPORTANCE", None, None), ("TRONCON_ROUTE", "NB_VOIES", None, None), (None, "commune_code", None, None)]


def _within(low: float, high: float):
    return lambda x: F.when((x >= low) & (x <= high), x)


def observations(features: DataFrame) -> DataFrame:
    """One row per feature and field that its kind should have: (feature_id, kind, field_name, entity, place, vintage, at, num, cat); num and cat null where missing."""
    cols = []
    for layer, field, low, high in FIELDS:
        raw = F.col(field) if layer is None else F.col(f"j.{field}")
        own = F.lit(True) if layer is None else F.col("layer") == layer
        if low is None:
            num, cat = F.lit(None).cast("double"), F.when(~M.is_placeholder(raw), M.trimmed(raw))
        else:
            num = M.let(M.measure(raw, F.lit("m"), 6).cast("double"), _within(low, high))
            cat = F.lit(None).cast("string")
        cols.append(F.when(own, F.struct(F.lit(field).alias("field_name"), F.lit(low is not None).alias("numeric"), num.alias("num"), cat.alias("cat"))))
    # the properties are parsed once, for the fields wanted
    wanted = ", ".join(f"{field} string" for layer, field, _, _ in FIELDS if layer is not None)
    src = features.filter("feature_id is not null").withColumn("j", F.from_json("properties", wanted)).select(
        "feature_id", F.col("layer").alias("kind"), F.coalesce("feature_code", F.concat(F.lit("#"), F.col("feature_id").cast("string"))).alias("entity"),
        F.col("commune_code").alias("place"), "vintage", F.coalesce(F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), F.array_compact(F.array(*cols)).alias("f"),
    )
    return src.select("feature_id", "kind", "entity", "place", "vintage", "at", F.explode("f").alias("f")).select("feature_id", "kind", "entity", "place", "vintage", "at", "f.*")


KEYS = ["field_name", "entity"]
ORDER = [*KEYS, "at", "feature_id"]
DAY = 86_400e6


def thousandths(x):
    """Rounded to three places, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000.0


def _parts(obs: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The observations with 'part', and (keys, part, before, after): what parts of one entity carry to each other, or None.

    Only entities with more than part_rows rows have more than one part; the row id ends their order, so equal times are cut, too.
    """
    hot = obs.groupBy(*KEYS).count().filter(F.col("count") > part_rows).select(*KEYS)
    if not hot.limit(1).count():
        return obs.withColumn("part", F.lit(0)), None
    hot = bounded(hot)  # at most one row for each part_rows observations
    own = obs.join(hot, KEYS, "left_semi")
    own = stored(own.repartitionByRange(2 * -(-own.count() // part_rows), *ORDER).withColumn("part", F.spark_partition_id()))
    seen = F.when(F.col("num").isNotNull() | F.col("cat").isNotNull(), F.struct("at", "feature_id", "num", "cat"))
    ends = own.groupBy(*KEYS, "part").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    w = Window.partitionBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    slim = lambda c: F.struct(c["at"].alias("at"), c["num"].alias("num"), c["cat"].alias("cat"))
    before = F.last(F.when(F.col("last").isNotNull(), slim(F.col("last"))), ignorenulls=True).over(w.orderBy("part"))
    after = F.last(F.when(F.col("first").isNotNull(), slim(F.col("first"))), ignorenulls=True).over(w.orderBy(F.col("part").desc()))
    carried = stored(ends.select(*KEYS, "part", before.alias("before"), after.alias("after")))
    return obs.join(hot, KEYS, "left_anti").withColumn("part", F.lit(0)).unionByName(own), carried


def by_time(obs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The observations with gaps filled from the same entity, with method and gap_days; rows it can't fill have a null method."""
    cut, carried = _parts(obs, part_rows)
    seen = F.when(F.col("num").isNotNull() | F.col("cat").isNotNull(), F.struct("at", "num", "cat"))
    # two orders, as a frame that runs to the end of its partition is summed up anew for every row
    near = lambda *order: F.last(seen, ignorenulls=True).over(Window.partitionBy(*KEYS, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = cut.withColumn("p", near("at", "feature_id")).withColumn("n", near(F.col("at").desc(), F.col("feature_id").desc()))
    if carried is not None:
        t = t.join(bounded(carried), [*KEYS, "part"], "left").withColumn("p", F.coalesce("p", "before")).withColumn("n", F.coalesce("n", "after")).drop("before", "after")
    missing = F.col("num").isNull() & F.col("cat").isNull()
    back, ahead = (F.col("at") - F.col("p.at")) / DAY, (F.col("n.at") - F.col("at")) / DAY
    gap = F.least(back, ahead)
    both = missing & F.col("numeric") & F.col("p.num").isNotNull() & F.col("n.num").isNotNull()
    carry = missing & ~both & F.coalesce(gap <= GAP_DAYS, F.lit(False))
    pick = F.when(ahead.isNull() | F.coalesce(back <= ahead, F.lit(False)), F.col("p")).otherwise(F.col("n"))
    share = F.when(F.col("n.at") > F.col("p.at"), (F.col("at") - F.col("p.at")) / (F.col("n.at") - F.col("p.at"))).otherwise(0.5)
    method = F.when(~missing, "observed").when(both, "interpolated").when(carry, "carried")
    between = thousandths(F.col("p.num") + (F.col("n.num") - F.col("p.num")) * share)
    return t.select(
        "feature_id", "kind", "field_name", "entity", "place", "vintage", "numeric",
        F.when(both, between).when(carry & F.col("numeric"), pick["num"]).otherwise(F.col("num")).alias("num"), F.when(carry & ~F.col("numeric"), pick["cat"]).otherwise(F.col("cat")).alias("cat"),
        method.alias("method"), F.when(both | carry, thousandths(gap)).when(~missing, F.lit(0.0)).alias("gap_days"),
    )


GROUP = ["kind", "place", "vintage", "field_name"]
LEVELS = [("group_place_vintage", ["kind", "place", "vintage"]), ("group_place", ["kind", "place"]), ("group_vintage", ["kind", "vintage"]), ("group_kind", ["kind"])]


def group_values(asked: DataFrame, obs: DataFrame) -> DataFrame:
    """asked(kind, place, vintage, field_name), each once, with num, cat and method of the narrowest group that has a value."""
    seen = obs.filter("num is not null or cat is not null").filter("field_name <> 'commune_code' or place is not null")
    # counts by value first, so that a group of any size is a few rows per task; numbers are summed as whole millionths
    counts = stored(seen.groupBy(*GROUP, "numeric", "cat").agg(F.count("*").alias("n"), F.sum(F.round(F.col("num") * 1e6).cast("bigint")).alias("s")))
    for name, keys in LEVELS:
        sums = counts.filter("numeric").groupBy(*keys, "field_name").agg((F.floor(F.sum("s").cast("double") / F.sum("n") / 100_000 + 0.5) / 10.0).alias("num"))
        modes = counts.filter("not numeric").groupBy(*keys, "field_name", "cat").agg(F.sum("n").alias("n")).groupBy(*keys, "field_name").agg(F.min_by("cat", F.struct(-F.col("n"), "cat")).alias("cat"))
        stats = sums.withColumn("cat", F.lit(None).cast("string")).unionByName(modes.withColumn("num", F.lit(None).cast("double")))
        stats = stats.select(*[F.col(k).alias(f"own_{k}") for k in [*keys, "field_name"]], F.struct("num", "cat").alias(name))
        on = [F.col(k).eqNullSafe(F.col(f"own_{k}")) if k == "kind" else F.col(k) == F.col(f"own_{k}") for k in [*keys, "field_name"]]
        asked = asked.join(stats, on, "left").drop(*[f"own_{k}" for k in [*keys, "field_name"]])
    names = [name for name, _ in LEVELS]
    value = F.coalesce(*names)
    method = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names], F.lit("none"))
    return asked.select(*GROUP, value["num"].alias("num"), value["cat"].alias("cat"), method.alias("method"))


def by_group(filled: DataFrame, obs: DataFrame) -> DataFrame:
    """Rows still open take the mean (numbers, to 0.1) or the most frequent value (categories; ties: the smallest) of the narrowest group."""
    done = filled.filter("method is not null")
    rest = filled.filter("method is null").drop("num", "cat", "method", "gap_days").withColumn("group", F.struct(*GROUP))
    # what a group gives is looked up once a group; the rows of a group of any size then meet one row
    found = stored(group_values(rest.select(*GROUP).distinct(), obs)).select(F.struct(*GROUP).alias("group"), "num", "cat", "method")
    rest = salted_join(rest, found, ["group"], "feature_id").drop("group").withColumn("gap_days", F.lit(None).cast("double"))
    return done.unionByName(rest)


def fill(features: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """features to one row per feature and field: its value, method ('observed' or how it was filled) and distance in days."""
    obs = stored(observations(features))  # read several times from here on, the properties are parsed once
    return by_group(stored(by_time(obs, part_rows)), obs)
