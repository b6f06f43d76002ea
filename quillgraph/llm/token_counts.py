"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, slices, tables

_SEGMENT = re.compile(" +[^ ]*")
#: Worker caches are emptied at so many entries, and keep no key of over so many characters.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48


def keys(text: str) -> list[str]:
    """The pre-tokens of a text.

    The model marks a word's start by the space before it and has no piece with a space after another character nor
    one with a line break, so no merge crosses these places and a text's length is the sum of its pre-tokens' lengths.
    Pre-tokens are runs of spaces with what follows them.  A key has one space less (the encoder adds one), so ``the``
    stands for a space and ``the``; a key that starts with a line break stands for what follows a word directly.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "\n" in text:
        text = text.replace("\n", " \n")
    found = text.split(" ")
    return [s[1:] for s in _SEGMENT.findall(" " + text)] if "" in found else found


class Lengths(dict):
    """Pre-token lengths: the broadcast table first, then this worker's cache, then the encoder."""

    def __init__(self, model: bytes | str, frequent: dict[str, int]):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.encoder.id_to_piece, range(self.encoder.get_piece_size()))
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces) or self.encoder.encode("a ", out_type=str) != ["▁a", "▁"]:
            raise ValueError("a piece of this model crosses a space or a line break: pre-token lengths don't add up")
        self.frequent = frequent
        super().__init__(frequent)

    def measure(self, key: str) -> int:
        bare = key.lstrip(" ")
        if not bare.startswith("\n"):
            return len(self.encoder.encode(key, num_threads=1)) if key else 1  # a space alone, which is a piece
        # keys() has put a space before each line break
        return len(self.encoder.encode(key[1:], num_threads=1)) if bare != key else len(self.encoder.encode(key, num_threads=1)) - 1

    def __missing__(self, key: str) -> int:
        n = self.measure(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= len(self.frequent) + CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, keys(text))) if text else 0


_worker: dict[int, Lengths] = {}


def frequent_keys(docs: DataFrame, entries: int = 16_384, rows: int = 20_000, held: int = 100_000) -> list[str]:
    """Pre-tokens for the broadcast table: the most frequent ones of about ``rows`` texts, drawn by hash from all.

    The table only saves time: lengths that it lacks are measured all the same, so no count depends on the draw.  Each
    task keeps a summary of at most ``held`` entries; what meets is bounded by the sample, whatever the corpus."""
    step = max(1, docs.count() // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(keys(text))
            if len(seen) > held:
                seen = Counter(dict(seen.most_common(held // 4)))
        top = [(k, n) for k, n in seen.most_common(entries) if len(k) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["key", "n"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")
    top = drawn.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(entries)
    return [r.key for r in top.collect()]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, entries: int = 16_384) -> DataFrame:
    """Tokens of each whole text as the sentencepiece model counts them, without added special tokens.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` and ``rest`` (all other columns but the text).  Rows are
    documents; repeated rows give repeated results.  A null text is empty: 0 bytes, 0 tokens.  Texts are counted
    whole, however long (a worker holds one text's pre-tokens, about 60 bytes each).  An empty table gives no rows.

    The driver measures ``entries`` frequent pre-tokens and broadcasts their lengths with the model (both of
    fixed size).  Tasks look up, then ask their worker's cache, then encode.  Documents aren't shuffled.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest"))
    with open(model, "rb") as f:
        proto = f.read()
    driver = Lengths(proto, {})
    frequent = {k: driver.measure(k) for k in frequent_keys(base, entries)}
    table = spark.sparkContext.broadcast((proto, frequent))
    key = hash((proto, tuple(frequent)))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), base.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:  # one for each worker process, kept from task to task
            _worker.clear()
            _worker[key] = Lengths(*table.value)
        count = _worker[key].count
        for batch in slices(batches):
            texts = batch.column("text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(map(count, texts.to_pylist()), pa.int64()), batch.column("rest")], names=schema.names)

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(tables(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
