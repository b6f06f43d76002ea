"""Benchmark decontamination: a broadcast hash set of test n-grams against the token windows of every document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, slices, tables

#: One pass: A-Z to lower case, every other ASCII byte that is no digit or letter to a space.  Bytes over 0x7F are
#: parts of words, as all code points over U+007F are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The n-grams of some items as a compact hash set: word numbers, and for each window length the sorted polynomial
    hashes of the different windows, where each stands in the items (to verify hits) and which items hold it.  Built
    once on the driver; a window takes about 30 bytes."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        flat, first, sizes, owner = [], [], [], []
        for item, text in items:
            got = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if got:
                windows = max(1, len(got) - n + 1)
                first += range(len(flat), len(flat) + windows)
                sizes += [min(n, len(got))] * windows
                owner += [item] * windows
                flat += got
        self.flat = np.array(flat, dtype=np.int32)
        self.values = np.random.default_rng(1).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.values[0] = 0
        self.items = sorted({o for o in owner if o is not None})
        number = {o: k for k, o in enumerate(self.items)}
        at, width = np.array(first, dtype=np.int64), np.array(sizes, dtype=np.int64)
        who = np.array([number.get(o, -1) for o in owner], dtype=np.int32)
        self.lengths = {}
        for size in map(int, np.unique(width)):
            mine = np.flatnonzero(width == size)
            ids = self.flat[at[mine][:, None] + np.arange(size)]
            sums = np.zeros(len(mine), np.uint64)
            for k in range(size):
                sums += self.values[ids[:, k]] * powers(_ODD, size)[k]
            order = np.lexsort((who[mine], *ids.T, sums))
            sums, ids, held, place = sums[order], ids[order], who[mine][order], at[mine][order]
            new = np.concatenate(([True], (sums[1:] != sums[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)))
            once = (held >= 0) & np.concatenate(([True], (held[1:] != held[:-1]) | new[1:]))
            ends = np.cumsum(np.bincount(np.cumsum(new) - 1, weights=once)).astype(np.int64)
            self.lengths[size] = sums[new], place[new], np.concatenate(([0], ends)), held[once]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Verified (first word, window length, items).  ``ids``: 0 is no word of any item."""
        none = np.concatenate(([0], np.cumsum(ids == 0)))
        raised = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[ids] * powers(_ODD, len(ids)), dtype=np.uint64)))
        for size, (sums, place, ends, held) in self.lengths.items():
            if size > len(ids):
                continue
            at = np.flatnonzero(none[size:] == none[:-size])
            if not len(at):
                continue
            found = (raised[at + size] - raised[at]) * powers(_INVERSE, len(ids))[at]
            k = np.minimum(np.searchsorted(sums, found), len(sums) - 1)
            hit = sums[k] == found
            for p, j, h in zip(at[hit], k[hit], found[hit], strict=True):
                while j < len(sums) and sums[j] == h:  # equal hashes are verified one by one
                    if np.array_equal(ids[p : p + size], self.flat[place[j] : place[j] + size]):
                        yield int(p), size, [self.items[i] for i in held[ends[j] : ends[j + 1]]]
                        break
                    j += 1


_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    have = _powers.get(of)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), of, dtype=np.uint64)
        have[0] = 1
        have = _powers[of] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def blocks(bench: DataFrame, n: int, max_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about ``max_words`` words; the driver holds one block at a time.  An item that is longer
    than a block is cut into overlapping pieces, which have the same windows."""
    block, size = [], 0
    for row in bench.select("item_id", "text").toLocalIterator():
        all_words = words((row.text or "").encode())
        for i in range(0, max(1, len(all_words) - n + 1), max_words):
            piece = all_words[i : i + max_words + n - 1]
            if block and size + len(piece) > max_words:
                yield block
                block, size = [], 0
            block.append((row.item_id, b" ".join(piece)))
            size += len(piece)
    yield block


_SPANS = "array<struct<start:bigint,stop:bigint>>"


def _scan(docs: DataFrame, items: list, n: int, keep_text: bool) -> DataFrame:
    """``docs`` with ``n_words, spans, items``; the text stays in its place, without the spans, or is left out."""
    table = docs.sparkSession.sparkContext.broadcast(Windows(items, n))
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"n_words bigint, spans {_SPANS}, items array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = table.value
        number = windows.vocabulary.get
        for batch in slices(batches, limit=1 << 20):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            flat, ends = [], []
            for text in texts:
                flat += [number(w, 0) for w in words(text or b"")]
                ends.append(len(flat))
                flat.append(0)  # windows never cross documents
            spans, items_of = [[] for _ in texts], [set() for _ in texts]
            for p, size, owners in sorted(windows.hits(np.array(flat, dtype=np.int64)), key=lambda h: h[:2]):
                d = int(np.searchsorted(ends, p))
                first = ends[d - 1] + 1 if d else 0
                items_of[d].update(owners)
                if (own := spans[d]) and p - first <= own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], p - first + size)
                else:
                    own.append({"start": p - first, "stop": p - first + size})
            counts = [e - (ends[d - 1] + 1 if d else 0) for d, e in enumerate(ends)]
            made = [pa.array(counts, pa.int64()), pa.array(spans, _arrow_spans()), pa.array([sorted(s) for s in items_of], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(_cut_out(batch, texts, spans) if name == "text" else batch.column(name) for name in names), *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def _arrow_spans() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut_out(batch: pa.RecordBatch, texts: list, spans: list) -> pa.Array:
    """The texts without the spans; the column itself where there are none."""
    if not any(spans):
        return batch.column("text")
    return pa.array([t if t is None else (without(t, s) if s else t).decode() for t, s in zip(texts, spans, strict=True)], batch.schema.field("text").type)


def _without_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` taken out of ``text``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [s or [] for s in batch.column("spans").to_pylist()]
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([_cut_out(batch, texts, spans) if name == "text" else batch.column(name) for name in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["stop"] - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, max_words: int = 2_000_000, keep_text: bool = True) -> DataFrame:
    """Find the words of documents that lie in a window of ``n`` words of a benchmark item.

    Returns ``doc_id, n_words, n_hit, items`` (sorted), ``spans`` (word numbers, stop excluded, merged), ``text``
    without the spans (null if ``keep_text`` is off) and ``rest`` (all other columns).  Removing spans or whole
    documents is then a projection or a filter on ``n_hit``.

    The items' n-grams are broadcast as a hash set (arrays, built once) if they have at most ``max_words`` words; more of them come in
    blocks of that size, each one more pass over the documents, merged by document.  Documents are never shuffled for
    one block.  Hits by hash are verified word by word.

    Rows are documents; repeated rows give repeated results.  Null texts have no words.  An item without words has no
    window.  An item whose item_id is null marks words and is named in no list; repeated item_ids are one item.
    Empty tables: no rows, or no hits.
    """
    base = docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest"))
    loads = blocks(bench, n, max_words)
    first = next(loads)
    more = next(loads, None)
    if more is None:
        found = _scan(base, first, n, keep_text)
    else:
        # a text's blocks meet by (doc_id, hash of the text); rows that repeat both have the same hits
        base = base.withColumn("sign", F.xxhash64("text"))
        keyed = base.select("doc_id", "sign", "text")
        parts = _scan(keyed, first, n, False)
        while more is not None:
            parts = parts.unionByName(_scan(keyed, more, n, False))
            more = next(loads, None)
        merged = parts.groupBy(F.col("doc_id").alias("id"), F.col("sign").alias("sg")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = merged.withColumn("spans", _merged("raw")).drop("raw")
        found = base.join(merged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sign") == F.col("sg"))).drop("id", "sg", "sign")
        found = _without_spans(found) if keep_text else found
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"]), F.lit(0).cast("long"))
    text = F.col("text") if keep_text else F.lit(None).cast("string")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", text.alias("text"), "rest")


def _merged(spans: str):
    """Sorted spans, overlapping or touching ones joined."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], s["stop"]).alias("stop"))))
    return F.aggregate(spans, empty, lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["stop"]), joined(acc, s)).otherwise(F.concat(acc, F.array(s))))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "benchmark"), keep_text=False)
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1 : i + 10], ' ') AS gram FROM bi),
ks AS (SELECT DISTINCT k FROM g),
di AS (SELECT doc_id, k, w, unnest(range(greatest(0, len(w) - k + 1))) AS i FROM dw, ks),
h AS (SELECT di.doc_id, di.i, di.k, g.item_id FROM di JOIN g ON g.k = di.k AND g.gram = array_to_string(di.w[di.i + 1 : di.i + di.k], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON hw.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id
"""
