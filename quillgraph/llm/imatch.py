"""I-Match fingerprints: terms of a band of inverse document frequencies, hashed under several random lexicons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import others, tables

#: Chances, in 256ths, that a term of the band is in a random lexicon: strict lexicons first, then ever smaller ones,
#: which still agree on texts of which a large part differs.  Eight lexicons share one 64-bit hash of the term.
LEXICONS = (*[64] * 8, *[16] * 8, *[4] * 8, *[2] * 24)
EMPTY = 42  # the hash of no terms, which no lexicon counts as agreement


def terms(text: Column) -> Column:
    """Distinct terms (runs of letters and digits, lower case) as 64-bit hashes."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float, high: float) -> tuple[list[int], int]:
    """Hashes of the terms with low <= ln(documents / documents with the term) <= high, over all documents.

    A term of the band is in at least exp(-high) of the documents, so the lexicon has at most exp(high) times the mean
    number of distinct terms a document, however many documents there are."""
    n = docs.count()
    if not n:
        return [], 0
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = found.where((F.col("df") >= n * math.exp(-high)) & (F.col("df") <= n * math.exp(-low)))
    return sorted(r.term for r in band.select("term").collect()), n


def _table(hashes: list[int]) -> tuple[list[int], int]:
    """A cuckoo hash table: each hash is in one of two slots, so that two array reads settle membership."""
    bits = max(4, math.ceil(math.log2(3 * len(hashes) + 1)))
    while True:
        mask, slots = (1 << bits) - 1, [0] * (1 << bits)
        for h in hashes:
            at = h & mask
            for _ in range(200):
                h, slots[at] = slots[at], h
                if not h:
                    break
                at = (h & mask) ^ ((h >> 32) & mask) ^ at if (h & mask) != ((h >> 32) & mask) else at
            if h:
                break
        else:
            return slots, mask
        bits += 1


def _held(hashes: list[int]):
    """A test of membership of the lexicon, as a column function without a join."""
    slots, mask = _table([h for h in hashes if h])
    table = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<bigint>")  # folded into one literal
    # 0 marks a free slot: the term whose hash is 0 is in no lexicon
    return lambda h: (h != 0) & ((F.get(table, h.bitwiseAND(F.lit(mask)).cast("int")) == h) | (F.get(table, F.shiftright(h, 32).bitwiseAND(F.lit(mask)).cast("int")) == h))


def imatch(text: Column, in_band) -> Column:
    """An array of one 32-bit hash for each random lexicon: the sorted distinct terms of the text that are in the band
    and in that lexicon, hashed in order; 0 where there are none."""
    every = terms(text)  # used once
    # nested in one-element transforms, so that each step is computed once and used many times
    once = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def drawn(i: int, most: int):
        return lambda g: F.shiftrightunsigned(g, 8 * (i % 8)).bitwiseAND(F.lit(255)) < most

    def salted(w: int):
        return lambda t: F.xxhash64(F.lit(w), t)

    def hashed(sorted_terms: Column) -> Column:
        words = [F.transform(sorted_terms, salted(w)) for w in range(math.ceil(len(LEXICONS) / 8))]
        return once(F.array(*words), lambda ws: F.array(*[F.xxhash64(F.filter(F.get(ws, i // 8), drawn(i, most))) for i, most in enumerate(LEXICONS)]))

    chosen = F.array_sort(F.filter(every, in_band))
    return F.transform(once(chosen, hashed), lambda h: F.when(h == EMPTY, F.lit(0).cast("long")).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF))))


def shown(prints: Column) -> Column:
    return F.lower(F.array_join(F.transform(prints, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the lexicons that agree, of those in which either text has terms; 1 for two texts without terms."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 257).otherwise(256))
    # 256 for each lexicon that counts and 1 more for each that agrees
    total = F.aggregate(both, F.lit(0), lambda s, v: s + v)
    valid = F.floor(total / 256)
    return F.when(valid == 0, F.lit(1.0)).otherwise((total % 256) / valid)


def fingerprints(docs: DataFrame, low: float = 2.0, high: float = 5.0) -> DataFrame:
    """``doc_id, fingerprint`` (array of longs) and ``rest`` for each row.

    Rows are documents.  Null and empty texts, and texts without terms, have a fingerprint of zeros; equal texts have
    equal ones.  An empty table gives no rows.  Documents aren't shuffled; only term counts are.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), others(docs, "doc_id", "text").alias("rest"))
    held = _held(lexicon(base, low, high)[0])
    return base.select("doc_id", imatch(F.col("text"), held).alias("fingerprint"), "rest")


def with_next(docs: DataFrame, n: int, per_bucket: int = 2_000, max_buckets: int = 65_536) -> DataFrame:
    """``docs(doc_id, text)`` with ``bucket``, ``extra`` and ``next_text``, the text of the next document in descending
    order of doc_id (nulls last; after the last comes the first).

    The documents are dealt to buckets of about equal size at quantiles of doc_id.  Each quantile is a doc_id that
    leads its bucket; its row goes to the bucket before it as well, marked ``extra``, so that every window sees the
    row after its last one and no window needs all rows.  Equal doc_ids are ordered by text."""
    buckets = max(1, min(max_buckets, n // per_bucket))
    points = [i / buckets for i in range(1, buckets)]
    row = docs.agg(F.max("doc_id").alias("top"), (F.percentile_approx("doc_id", points, max(10_000, 4 * buckets)) if points else F.array().cast("array<bigint>")).alias("cuts")).first()
    leads = sorted({x for x in [row.top, *(row.cuts or [])] if x is not None}, reverse=True)
    if not leads:
        leads = [None]
    # bucket = how many leads are at or above the doc_id, less one: first among coarse steps, then within the step
    step = max(1, math.isqrt(len(leads)))
    held = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    if leads == [None]:
        bucket = F.lit(0)
    else:
        at_or_above = lambda array: F.size(F.filter(array, lambda x: x >= F.col("doc_id")))
        coarse = at_or_above(held(leads[::step]))
        bucket = (coarse - 1) * step + at_or_above(F.slice(held(leads), (coarse - 1) * step + 1, step)) - 1
        bucket = F.when(F.col("doc_id").isNull(), len(leads) - 1).otherwise(bucket)
    leading = F.col("doc_id").isNull() if leads == [None] else F.coalesce(F.get(held(leads), F.col("bucket")) == F.col("doc_id"), F.lit(False))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    there = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(leads))).cast("int").alias("bucket"), F.lit(True).alias("extra"))
    dealt = docs.withColumn("bucket", bucket.cast("int"))
    dealt = dealt.select(*docs.columns, F.explode(F.when(leading, F.array(here, there)).otherwise(F.array(here))).alias("to")).select(*docs.columns, "to.*")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")


def edit_study(docs: DataFrame, low: float = 2.0, high: float = 5.0) -> DataFrame:
    """Each document's fingerprint against that of its edited text (the last half replaced by the start of the next
    document in descending order of doc_id) and against the next document's.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.  Nulls, empty and
    repeated rows as in :func:`fingerprints`; a single document is its own next one.  Texts are shuffled once.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashes, n = lexicon(base, low, high)
    held = _held(hashes)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(base, n).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next_text", F.lit("")), half)))
    rows = rows.select("doc_id", "bucket", "extra", "text", "n_chars", "edited", imatch(F.col("text"), held).alias("fingerprint"), F.when(~F.col("extra"), imatch(F.col("edited"), held)).alias("edited_fingerprint"))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(_order())).where(~F.col("extra"))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = edit_study(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return study.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
