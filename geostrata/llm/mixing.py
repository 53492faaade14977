"""Records of several sources mixed so that each source has its share of the tokens.

Weighted sampling without replacement after Efraimidis and Spirakis: every document gets the key -ln(u) / w, u being
drawn from its id and w its quality weight; in order of the key the documents of a source are a weighted sample, so
the prefix up to a token budget is taken. Complete epochs come first, then the prefix of one more.

The order is never built for a whole source in one task: keys fall into bins of near equal size, the bins' token sums
are added up (one row a bin), and only inside a bin rows are ordered. A source of any size is many bins.

Nulls: a null source is the source 'unknown'; a null or empty text has 0 tokens and is not taken; a null id draws as id 0.
Ties of the key are in order of the id. Repeated rows of an id count as often as they occur. Sources that a mix names but
no document has are reported with 0 tokens; documents of unnamed sources only count for the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geostrata.llm.tokens import with_token_counts
from geostrata.runtime import stored

#: Documents that a bin should hold: a source of 10^11 documents has five million bins, one row each.
BIN_DOCS = 20_000


def source_key(source: Column) -> Column:
    """Spellings that differ in case, blanks and separators are one source."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", ""), F.lit("")), F.lit("unknown"))


def quality_weight(tokens: Column) -> Column:
    """From 1 to 2: documents of ordinary length weigh more than very short and very long ones."""
    far = F.abs(F.ln((tokens + 1) / F.lit(1200.0)))
    return F.lit(1.0) + F.exp(-far)


def drawn(doc_id: Column, seed: int = 7) -> Column:
    """A number between 0 and 1 from the id."""
    bits = F.shiftright(F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(0))), 11).cast("double")
    return (bits + F.lit(2.0**52) + 0.5) / F.lit(2.0**53)


def sizes(docs: DataFrame, seed: int = 7, weight: Column | None = None, size: Column | None = None, draw: Column | None = None) -> DataFrame:
    """(doc_id, source_key, tokens, key): the size and sampling key of every document, stored.

    weight: a quality weight above 0 over the columns of docs and 'tokens' (by length if none is given; other values count as 1);
    size: another measure than tokens; draw: another draw than by the id's hash.
    """
    if size is not None:
        t = docs.withColumn("tokens", size)
    elif weight is None:
        t = with_token_counts(docs.select("doc_id", "source", "text"))
    else:
        t = with_token_counts(docs)
    w = quality_weight(F.col("tokens")) if weight is None else weight.cast("double")
    w = F.when(w > 0, w).otherwise(1.0)
    u = drawn(F.col("doc_id"), seed) if draw is None else draw
    return stored(t.select("doc_id", source_key(F.col("source")).alias("source_key"), F.coalesce(F.col("tokens"), F.lit(0)).cast("int").alias("tokens"), (-F.ln(u) / w).alias("key")))


def budgets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target tokens, tokens there are, epochs that are taken whole and tokens of the last, partial one."""
    own = sized.groupBy("source_key").agg(F.sum(F.col("tokens").cast("bigint")).alias("source_tokens"), F.count("*").alias("source_docs"))
    whole = own.agg(F.sum("source_tokens").alias("all_tokens"))
    t = targets.select("mix_id", "source_name", source_key(F.col("source_name")).alias("source_key"), "total_factor", "target_share", "max_repeat")
    # a single row on one side
    t = t.join(F.broadcast(whole), F.lit(True), "left").join(own, "source_key", "left")
    zero = F.lit(0).cast("bigint")
    t = t.withColumn("source_tokens", F.coalesce("source_tokens", zero)).withColumn("source_docs", F.coalesce("source_docs", zero))
    t = t.withColumn("target_tokens", F.col("total_factor") * F.col("target_share") * F.coalesce("all_tokens", zero))
    t = t.withColumn("capacity", F.col("max_repeat") * F.col("source_tokens"))
    t = t.withColumn("taken", F.least("target_tokens", F.col("capacity").cast("double")))
    t = t.withColumn("epochs", F.when(F.col("source_tokens") > 0, F.floor(F.col("taken") / F.col("source_tokens"))).otherwise(0).cast("int"))
    return t.withColumn("partial", F.col("taken") - F.col("epochs") * F.col("source_tokens"))


def prefix_sums(sized: DataFrame) -> DataFrame:
    """The documents with 'before': tokens of the documents of the same source with a smaller key."""
    docs = sized.filter("tokens > 0")
    n = docs.groupBy("source_key").agg((F.floor(F.count("*") / BIN_DOCS) + 1).alias("bins"))
    # exp(-key) is near uniform for weights from 1 to 2: the densest bin has twice the mean; other weights only make bins less even
    d = docs.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, "source_key").withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * F.col("bins")))
    sums = d.groupBy("source_key", "bin").agg(F.sum(F.col("tokens").cast("bigint")).alias("s"))
    up = sums.select("source_key", "bin", (F.sum("s").over(Window.partitionBy("source_key").orderBy("bin")) - F.col("s")).alias("bin_before"))
    inside = F.sum(F.col("tokens").cast("bigint")).over(Window.partitionBy("source_key", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    return d.withColumn("inside", inside).join(up, ["source_key", "bin"]).select("doc_id", "source_key", "tokens", "key", (F.col("bin_before") + F.col("inside")).alias("before"))


def select(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source_name, doc_id, tokens, copies): how often each document is in each mix; documents not in it are left out.

    The last document is taken when at least half of it fits, so a source misses its budget by half a document at most.
    """
    b = budgets(sized, targets).select("mix_id", "source_name", "source_key", "epochs", "partial")
    b = F.broadcast(b) if b.limit(100_001).count() <= 100_000 else b
    copies = F.col("epochs") + (F.col("before") + F.col("tokens") / 2 <= F.col("partial")).cast("int")
    return prefix_sums(sized).join(b, "source_key").withColumn("copies", copies).filter("copies > 0").select("mix_id", "source_name", "doc_id", "tokens", "copies")


def report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source the target, what was selected, the share reached and whether the repeats allow the target."""
    got = select(sized, targets).groupBy("mix_id", "source_name").agg(F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("selected_tokens"), F.count("*").alias("selected_docs"), F.max("copies").alias("most_copies"))
    b = budgets(sized, targets)
    t = b.join(got, ["mix_id", "source_name"], "left").fillna(0, ["selected_tokens", "selected_docs", "most_copies"])
    total = t.groupBy("mix_id").agg(F.sum("selected_tokens").alias("mix_tokens"))
    t = t.join(total, "mix_id")
    reached = F.when(F.col("mix_tokens") > 0, F.col("selected_tokens") / F.col("mix_tokens"))
    return t.select("mix_id", "source_name", "target_share", "target_tokens", "source_tokens", "max_repeat", "epochs", "selected_docs", "selected_tokens", "most_copies", reached.alias("reached_share"), (F.col("target_tokens") > F.col("capacity")).alias("short"))
