"""The pN_ queries of the text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import leaks, mixing, sentences
from geostrata.runtime import read

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a mix that can't reach their share."""
    r = mixing.report(mixing.sizes(read(spark, sf_dir, "documents")), read(spark, sf_dir, "mix_target"))
    # what the selection reached is part of the test, so the selection is made
    return r.filter("short and selected_tokens < target_tokens").select("mix_id", "source_name")


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, selections and shares reached of every mix and source."""
    r = mixing.report(mixing.sizes(read(spark, sf_dir, "documents")), read(spark, sf_dir, "mix_target"))
    return r.withColumn("target_tokens", F.round("target_tokens", 1)).withColumn("reached_share", F.round("reached_share", 6))


def _by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in characters and draws by MD5, which SQL has, too."""
    d = read(spark, sf_dir, "documents")
    draw = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    return mixing.sizes(d, size=F.length("text"), draw=draw)


@query
def p7_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of every mix with its copies, sizes in characters."""
    return mixing.select(_by_characters(spark, sf_dir), read(spark, sf_dir, "mix_target")).select("mix_id", "source_name", "doc_id", F.col("copies").cast("int").alias("copies"))


@query
def p7_report_by_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the same."""
    r = mixing.report(_by_characters(spark, sf_dir), read(spark, sf_dir, "mix_target"))
    return r.select("mix_id", "source_name", "epochs", "selected_docs", "selected_tokens", F.round("target_tokens", 1).alias("target_tokens"), F.round("reached_share", 6).alias("reached_share"), "short")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a test item."""
    found = leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"))
    return found.filter(F.col("longest_run") >= leaks.WINDOW).select("doc_id", "item_id")


@query
def p6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the bare words, with commands and comment signs left in as words: what SQL can say."""
    found = leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"), reading=str.lower)
    return found.filter(F.col("longest_run") >= leaks.WINDOW).select("doc_id", "item_id")


@query
def p6_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item nearly whole, with some of its words altered: by item-sized windows and shingle similarity."""
    found = leaks.altered(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query
def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item the documents it leaked into, the longest run of its words and how many hold it nearly whole."""
    found = leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_item"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("longest_run").alias("longest_run"), F.sum((F.col("similarity") >= 0.8).cast("int")).alias("whole_docs"))


# words, figures and signs stand for tokens: any usual tokenizer gives the same rows
SQL["p7_found"] = r"""
WITH d AS (
  SELECT coalesce(nullif(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g'), ''), 'unknown') AS k,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]')) AS n FROM documents),
s AS (SELECT k, sum(n) AS n FROM d GROUP BY 1)
SELECT m.mix_id, m.source_name FROM mix_target m
LEFT JOIN s ON s.k = regexp_replace(lower(m.source_name), '[^\p{L}\p{N}]+', '', 'g')
WHERE m.target_share * m.total_factor * (SELECT sum(n) FROM s) > m.max_repeat * coalesce(s.n, 0)
"""


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every sentence's last character."""
    # ends within a text differ, and doc_id is unique: nothing to make distinct
    return sentences.sentence_ends(read(spark, sf_dir, "documents")).select("doc_id", "sent_end")


@query
def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their mean distance by language as stored."""
    docs = read(spark, sf_dir, "documents")
    ends = sentences.sentence_ends(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("sent_end").alias("last"))
    return docs.select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang")).join(ends, "doc_id").groupBy("lang").agg(F.sum("n").alias("sentences"), F.round(F.sum("last") / F.sum("n"), 2).alias("mean_chars"))


SQL["p6_words"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12)),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE passage IS NOT NULL),
r AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT d.doc_id, r.item_id FROM d JOIN r ON r.run = d.run
"""
_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce(nullif(regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g'), ''), 'unknown') AS k, length(coalesce(text, '')) AS n,
    -ln((CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / (1.0 + exp(-abs(ln((length(coalesce(text, '')) + 1) / 1200.0)))) AS key FROM documents),
s AS (SELECT k, sum(n)::BIGINT AS n FROM d GROUP BY 1),
b AS (
  SELECT m.mix_id, m.source_name, s.k, coalesce(s.n, 0) AS n, m.total_factor * m.target_share * (SELECT sum(n)::BIGINT FROM s) AS target, CAST(m.max_repeat * coalesce(s.n, 0) AS DOUBLE) AS capacity
  FROM mix_target m LEFT JOIN s ON s.k = coalesce(nullif(regexp_replace(lower(m.source_name), '[^\p{L}\p{N}]+', '', 'g'), ''), 'unknown')),
e AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(least(target, capacity) / n) AS INTEGER) ELSE 0 END AS epochs FROM b),
p AS (SELECT *, least(target, capacity) - epochs * n AS rest FROM e),
o AS (SELECT doc_id, k, n, sum(n) OVER (PARTITION BY k ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n AS before FROM d WHERE n > 0),
t AS (SELECT mix_id, source_name, doc_id, o.n, epochs + CASE WHEN before + o.n / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM o JOIN p ON p.k = o.k)
"""
SQL["p7_by_characters"] = _MIX + "SELECT mix_id, source_name, doc_id, CAST(copies AS INTEGER) AS copies FROM t WHERE copies > 0"
SQL["p7_report_by_characters"] = _MIX.rstrip() + """,
g AS (SELECT mix_id, source_name, count(*) AS docs, sum(n * copies)::BIGINT AS tokens FROM t WHERE copies > 0 GROUP BY 1, 2)
SELECT p.mix_id, p.source_name, epochs, coalesce(docs, 0) AS selected_docs, coalesce(tokens, 0) AS selected_tokens, round(target, 1) AS target_tokens,
  round(coalesce(tokens, 0) / sum(coalesce(tokens, 0)) OVER (PARTITION BY p.mix_id), 6) AS reached_share, target > capacity AS short
FROM p LEFT JOIN g ON g.mix_id = p.mix_id AND g.source_name = p.source_name
"""
