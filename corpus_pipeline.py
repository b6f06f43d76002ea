"""From raw documents to a mixed training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
Null texts, empty tables, repeated rows and extra columns are as the operators define them.  A stage that changes a
text sets ``n_chars`` (where there is such a column) to its new length.  Stages that run Python set the session's size of
Arrow batches, if it has none.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillgraph.llm.common import cut, sifted  # noqa: E402
from quillgraph.llm.decontaminate import decontaminate  # noqa: E402
from quillgraph.llm.entropy_mix import entropy_mix  # noqa: E402
from quillgraph.llm.line_dedup import line_dedup  # noqa: E402
from quillgraph.llm.simhash import similar_documents  # noqa: E402
from quillgraph.llm.toxicity import toxicity  # noqa: E402
from quillgraph.session import small_batches  # noqa: E402

#: Near-duplicates have sets of 5-word shingles with this Jaccard similarity or more; fingerprints within 3 bits are candidates.
SHINGLE, BITS, SIMILARITY = 5, 3, 0.8
#: A document of which at least this share of words lies in benchmark windows goes; of others, only these words.
MOST_HIT = 0.5


def _documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, text, rest`` as the columns of ``docs``, in their order."""
    of = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return changed.select(*[of[c] if c in of else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = scored.where("predicted = 0")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays, with the smallest doc_id that there is.  Rows without an id and different texts
    of one doc_id are documents of their own: they go only if their group has another.

    What goes is looked up among the texts; all others stay where they are, as they are not in the sieve of what goes."""
    small_batches(spark)
    sign = F.xxhash64("text")
    classes = similar_documents(docs.select("doc_id", "text", sign.alias("sign")), BITS, SHINGLE, SIMILARITY).select("root", "doc_id", "component_id", F.col("rest.sign").alias("sign"))
    heads = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("sign").alias("kept_sign"))
    head = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sign") == F.col("kept_sign"))
    gone = cut(classes.join(heads, "root").where(~head).select(F.col("doc_id").alias("gone_id"), F.col("sign").alias("gone_sign")).distinct())
    told = sifted(docs, F.xxhash64(sign, "doc_id"), gone, F.xxhash64("gone_sign", "gone_id"))
    lost = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (sign == F.col("gone_sign"))
    kept = told.where("not hit").union(told.where("hit").join(gone, lost, "left_anti")).drop("hit")
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return kept if ids.n == ids.d else kept.withColumn("_sign", sign).dropDuplicates(["doc_id", "_sign"]).drop("_sign")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(found.where(F.col("n_hit") < F.greatest(F.lit(1.0), MOST_HIT * F.col("n_words"))), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document with its text and other columns, and how often the mix takes it
    (``copies``; 0: left out), with the figures behind it.

    The mix is solved on rows without texts.  Its decisions meet the texts by doc_id, source and hash of the text; rows
    that repeat all three are told apart by their number, which of them takes which decision doesn't matter."""
    sign = F.xxhash64("text").alias("sign")
    key = ["doc_id", "source", "sign"]
    mixed = entropy_mix(docs.select("doc_id", "source", "text", sign)).select("doc_id", "source", F.col("rest.sign").alias("sign"), F.struct("size", "source_size", "target", "rate", "copies", "taken").alias("mix"))
    mixed = mixed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("mix")))
    whole = docs.select("doc_id", "source", sign, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    mixed = mixed.select(*[F.col(c).alias(f"m_{c}") for c in [*key, "nth", "mix"]])
    both = whole.join(mixed, F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("sign") == F.col("m_sign")) & (F.col("nth") == F.col("m_nth")))
    return both.select("doc.*", *[F.col("m_mix").getField(c).alias(c if c not in docs.columns else f"mix_{c}") for c in ("size", "source_size", "target", "rate", "copies", "taken")])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models, components and Newton iterations are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last keeps is written to the shared folder once, and read from there by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
