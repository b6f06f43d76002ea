"""Line dedup: count the documents that hold each normalised line and drop the lines of the common ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, others, tables


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents, except in the largest doc_id that holds it.

    Returns ``doc_id, n_lines, n_dropped, text`` (what stays) and ``rest``, a struct of all other input columns.

    Rows of one doc_id are parts of one document, which counts once for a line, and all rows without a doc_id are one
    document too, smaller than any other; each row keeps its own result.  A null text is an empty line.  Lines under ``min_chars`` code points are never dropped.  An empty
    table gives no rows.  Input columns of any name are carried in ``rest``.

    Plan: one distinct count over 128-bit line hashes (first by hash and document, which spreads a line that all
    documents share, then partial sums by hash), one join of lines with the common hashes (Spark may split its skewed keys), and one join of
    the documents with the positions to drop.  No line text is shuffled but for the documents themselves.
    """
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), others(docs, "doc_id", "text").alias("rest"))
    base = base.withColumn("sign", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")]
    long = lambda key: F.char_length(key) >= min_chars

    once = base.select("doc_id", F.explode(F.array_distinct(F.filter(F.transform(lines, line_key), long))).alias("key"))
    common = once.select("doc_id", *hashes).groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs).drop("n")
    # written out: a join with an aggregate right below it can't have its skewed keys split
    common = cut(common)

    each = base.select("doc_id", "sign", F.posexplode(F.transform(lines, line_key)).alias("pos", "key")).where(long(F.col("key"))).select("doc_id", "sign", "pos", *hashes)
    lost = each.join(common, ["h1", "h2"]).where((F.col("doc_id") < F.col("top")) | (F.col("doc_id").isNull() & F.col("top").isNotNull()))
    lost = lost.groupBy(F.col("doc_id").alias("id"), F.col("sign").alias("sg")).agg(F.collect_set("pos").alias("gone"))

    whole = base.select("doc_id", "sign", lines.alias("lines"), "rest")
    both = whole.join(lost, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sign") == F.col("sg")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    # array_except hashes, so a document of a million lines costs no more for each line than a short one
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n").alias("text"), "rest")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id < c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
