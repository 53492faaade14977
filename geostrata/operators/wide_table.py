"""Entity-attribute-value rows into one wide row per entity with typed columns, by positional stitching.

Every entity gets a global ordinal. Each attribute is a typed column chunk aligned to a range of ordinals; the
chunks of a range are put side by side by position. No pivot over the whole table and no join per attribute.

Nulls: rows without an entity are dropped; rows whose name, value or time is null hold no value (a null time loses to
any other). Empty tables give an empty result with the same columns. Of rows that tie on time the one loaded last
counts, then the larger row number. Repeated rows change nothing. Other columns of the input are ignored. Integers are
64 bits, reals have up to 26 digits before the point; what doesn't fit counts as unreadable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geostrata.functions import measures as M
from geostrata.runtime import bounded, stored

#: Entities in an ordinal range: the unit that one task assembles at a time.
RANGE = 8192
#: Attributes are columns of the result, so their number is bounded.
MAX_ATTRIBUTES = 5000
KINDS = {"boolean": ("b", T.BooleanType()), "integer": ("i", T.LongType()), "real": ("r", T.DecimalType(38, 3)), "text": ("s", T.StringType())}


def catalogue(attributes: DataFrame) -> list[dict]:
    """The attribute list on the driver; its size is checked."""
    rows = attributes.select("attr_name", "data_kind", "base_unit", "alt_names").filter("attr_name is not null").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes can't be columns of one table")
    by_name = {r.attr_name: r for r in sorted(rows, key=lambda r: r.attr_name, reverse=True)}
    return [
        {"no": k, "name": n, "kind": by_name[n].data_kind if by_name[n].data_kind in KINDS else "text", "unit": by_name[n].base_unit, "names": [n, *(x for x in by_name[n].alt_names or [] if x)]}
        for k, n in enumerate(sorted(by_name))
    ]


def typed_cells(rows: DataFrame, attrs: list[dict]) -> DataFrame:
    """(guid, no, b, i, r, s): the value that counts of each cell."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(n, a["no"], a["kind"], a["unit"]) for a in attrs for n in a["names"]], "name string, no int, kind string, unit string")
    names = names.select(M.name_key(F.col("name")).alias("key"), "no", "kind", "unit").filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("no", "kind", "unit"), "no").alias("a")).select("key", "a.*")
    src = rows.filter("guid is not null").select("guid", M.name_key(F.col("prop_name")).alias("key"), "prop_value", "exported_at", "loaded_at", "row_no")
    def value(bare: Column) -> Column:
        some = ~M.is_placeholder(bare)
        kind = F.col("kind")
        return F.struct(
            F.when(some & (kind == "boolean"), M.boolean(bare)).alias("b"),
            F.when(some & (kind == "integer"), M.let(M.number(bare), lambda x: F.when(x == F.floor(x), x.try_cast("bigint")))).alias("i"),
            F.when(some & (kind == "real"), M.measure(bare, F.col("unit"), 3)).alias("r"),
            F.when(some & (kind == "text"), bare).alias("s"),
        )

    src = src.join(bounded(names), "key").withColumn("v", M.let(M.bare_text(F.col("prop_value")), value))
    held = src.filter(F.coalesce(F.col("v.b").cast("string"), F.col("v.i").cast("string"), F.col("v.r").cast("string"), F.col("v.s")).isNotNull())
    newest = F.struct("exported_at", "loaded_at", "row_no")
    # max_by combines on the map side, so an entity that holds a third of all rows is a few rows per task here
    return held.groupBy("guid", "no").agg(F.max_by("v", newest).alias("v")).select("guid", "no", "v.*")


def ordinals(entities: DataFrame, key: str = "guid") -> DataFrame:
    """Dense global ordinals from 0 of distinct entities: order within hash buckets, plus the sizes of the buckets before."""
    own = stored(entities.select(key).distinct())  # few columns; read three times
    buckets = max(8, own.count() // (2 * RANGE) + 1)
    own = own.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = own.groupBy("bucket").count()
    # one row per bucket, n / 16384 of them
    before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1
    return own.withColumn("place", place).join(bounded(before), "bucket").select(key, (F.col("before") + F.col("place")).alias("ordinal"))


def column_names(attrs: list[dict]) -> list[str]:
    return [a["name"] + "_attr" if a["name"].lower() in ("guid", "entity_ordinal") else a["name"] for a in attrs]


def stitch(cells: DataFrame, attrs: list[dict]) -> DataFrame:
    """Typed chunks by ordinal range, put side by side by position."""
    names = column_names(attrs)
    schema = T.StructType([T.StructField("entity_ordinal", T.LongType()), T.StructField("guid", T.StringType()), *(T.StructField(n, KINDS[a["kind"]][1]) for n, a in zip(names, attrs, strict=True))])
    arrow = {"b": pa.bool_(), "i": pa.int64(), "r": pa.decimal128(38, 3), "s": pa.string()}
    plan = [(n, a["no"], KINDS[a["kind"]][0]) for n, a in zip(names, attrs, strict=True)]

    def assemble(chunk: pa.Table) -> pa.Table:
        no = chunk.column("no").to_numpy()
        at = chunk.column("ordinal").to_numpy()
        start = int(at.min()) // RANGE * RANGE
        own = np.flatnonzero(no == -1)
        size = int(at.max()) - start + 1
        order = np.argsort(no, kind="stable")
        cuts = np.searchsorted(no[order], [x for _, k, _ in plan for x in (k, k + 1)])

        def aligned(rows: np.ndarray, column: str) -> pa.Array:
            place = np.full(size, -1, dtype=np.int64)
            place[at[rows] - start] = rows
            values = chunk.column(column).combine_chunks()
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            return values.take(pa.array(place, mask=place < 0))

        out = {"entity_ordinal": pa.array(np.arange(start, start + size, dtype=np.int64)), "guid": aligned(own, "guid").cast(pa.string())}
        for k, (name, _, column) in enumerate(plan):
            out[name] = aligned(order[cuts[2 * k] : cuts[2 * k + 1]], column).cast(arrow[column])
        return pa.table(out)

    return cells.withColumn("span", F.expr(f"ordinal div {RANGE}")).groupBy("span").applyInArrow(lambda t: assemble(t), schema)


def widen(rows: DataFrame, attributes: DataFrame) -> tuple[DataFrame, list[dict]]:
    """rows(guid, prop_name, prop_value, exported_at, loaded_at, row_no) to (entity_ordinal, guid, a typed column for each attribute)."""
    attrs = catalogue(attributes)
    cells = typed_cells(rows, attrs)
    own = ordinals(rows.filter("guid is not null"))
    # the entity itself is the chunk row with no = -1
    wide = stitch(cells.join(own, "guid").unionByName(own.withColumn("no", F.lit(-1)), allowMissingColumns=True), attrs)
    return wide, attrs


def filled_cells(wide: DataFrame, attrs: list[dict]) -> DataFrame:
    """The wide table's filled cells as text: (guid, attr_name, cell_text)."""
    if not attrs:
        return wide.select("guid", F.lit("").alias("attr_name"), F.lit("").alias("cell_text")).limit(0)
    cells = F.array(*[F.struct(F.lit(a["name"]).alias("attr_name"), F.col(f"`{n}`").cast("string").alias("cell_text")) for n, a in zip(column_names(attrs), attrs, strict=True)])
    return wide.select("guid", F.explode(cells).alias("c")).select("guid", "c.*").filter("cell_text is not null")
