"""Periodic runs of words by longest previous factors.

A slice of documents is one array of words whose first key is the document, so no repeat crosses a border.  Prefix
doubling gives the suffix array; the ranks of each doubling are kept, and two places of equal rank at level k share their
first 2**k words, so the longest common prefix (or suffix, leftwards) of any two places takes one comparison a level.
From the suffix array and these prefixes follow longest previous factors, from them the LZ blocks.  A run that touches a
block's border is found by Main's extensions around that border; one inside a block is copied from the block's earlier
occurrence, by start.  All steps but the walk over blocks and the copying are numpy over all documents of a slice.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import others, slices, tables

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Candidates that are held at a time.
CHUNK = 1 << 20


class Ranks:
    """Ranks of all factors of 1, 2, 4, ... words of the documents; equal ranks mean equal words of one document."""

    def __init__(self, letters: np.ndarray, ends: np.ndarray):
        """``letters``: a number for each word, different in each document; ``ends``: each place's end of document."""
        n = len(letters)
        order = np.argsort(letters, kind="stable")
        rank, groups = np.empty(n, np.int32), letters[order]
        first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
        sizes = np.diff(first, append=n)
        rank[order] = np.repeat(first, sizes)
        self.levels, self.ends = [rank], ends
        self.open = order[np.repeat(sizes > 1, sizes)]

    def double(self) -> None:
        """One level more: only places that still share their rank are sorted."""
        rank, h, u = self.levels[-1], 1 << (len(self.levels) - 1), self.open
        then = u + h
        inside = then < self.ends[u]
        key = rank[u].astype(np.int64) << 32
        key[inside] |= rank[then[inside]] + 1
        order = np.argsort(key, kind="stable")
        u, key = u[order], key[order]
        group = key >> 32
        at = np.arange(len(u))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        own = np.concatenate(([True], group[1:] != group[:-1]))
        base = np.maximum.accumulate(np.where(own, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[u] = group + start - base
        self.levels.append(rank)
        sizes = np.diff(np.flatnonzero(new), append=len(u))
        self.open = u[np.repeat(sizes > 1, sizes)]

    def finish(self) -> None:
        while len(self.open):
            self.double()
        # a place after the last word, which equals none
        self.levels = [np.concatenate((r, np.array([-1], np.int32))) for r in self.levels]

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]) * np.int64(1 << k)
            i, j, out = i + step, j + step, out + step
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j (i < j)."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h = 1 << k
            step = ((i >= h) & (self.levels[k][np.maximum(i - h, 0)] == self.levels[k][np.maximum(j - h, 0)])) * np.int64(h)
            i, j, out = i - step, j - step, out + step
        return out


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """The last place before each whose value is smaller, or -1.  All values between a place and the one it points to
    are larger, so a pointer that is not there yet may take over the other's."""
    to = np.arange(-1, len(values) - 1)
    left = np.flatnonzero(to >= 0)
    while len(left):
        left = left[values[to[left]] > values[left]]
        to[left] = to[to[left]]
        left = left[to[left] >= 0]
    return to


def longest_previous(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest factor that also starts before it in its document, and where."""
    suffixes = np.argsort(ranks.levels[-1][:-1])
    n = len(suffixes)
    best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # in the order of suffixes, the longest prefix with any earlier place is that with the nearest of smaller place
    for back in (False, True):
        seen = suffixes[::-1] if back else suffixes
        to = _nearest_smaller(seen)
        has = to >= 0
        own, other = seen[has], seen[to[has]]
        same = ranks.levels[0][own] == ranks.levels[0][other]
        own, other = own[same], other[same]
        found = ranks.right(own, other)
        longer = found > best[own]
        best[own[longer]], source[own[longer]] = found[longer], other[longer]
    return best, source


def _candidates(places: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, 1 to its length) of all places, in chunks."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, CHUNK):
        flat = np.arange(at, min(total, at + CHUNK))
        of = np.searchsorted(ends, flat, "right")
        yield places[of], flat - (ends[of] - lengths[of]) + 1


def _around(ranks: Ranks, x: np.ndarray, p: np.ndarray) -> Iterator[np.ndarray]:
    """Repetitions of period p around the pairs (x, x + p), as rows of start, end, period."""
    r0, r1 = ranks.levels[0], ranks.levels[min(1, len(ranks.levels) - 1)]
    y = x + p
    near = (r0[x] == r0[y]) | ((x > 0) & (r0[x - 1] == r0[y - 1]))
    x, y, p = x[near], y[near], p[near]
    # extensions of 6 words in all are wanted, so 2 to one side at least
    near = (r1[x] == r1[y]) | ((x > 1) & (r1[x - 2] == r1[y - 2]))
    x, y, p = x[near], y[near], p[near]
    if len(x):
        start, end = x - ranks.left(x, y), y + ranks.right(x, y)
        long = end - start >= np.maximum(LEAST, 2 * p)
        yield np.stack([start[long], end[long], p[long]], axis=1)


def all_runs(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """All runs (start, end, smallest period) of the documents that have any, by number of document, in order.

    ``letters``: the words of all documents as numbers, different in each document; ``starts`` and ``ends``: of each
    document.  A run repeats at least 6 words within its document, so documents whose factors of 4 words are all
    different are done after two doublings."""
    of = np.repeat(np.arange(len(starts)), ends - starts)
    ranks = Ranks(letters, ends[of] if len(of) else np.zeros(0, np.int64))
    ranks.double()
    ranks.double()
    kept = np.unique(of[ranks.open])
    if not len(kept):
        return {}
    inside = np.zeros(len(starts), bool)
    inside[kept] = True
    mine = inside[of]
    lengths = (ends - starts)[kept]
    base = np.cumsum(lengths) - lengths
    ranks = Ranks(letters[mine], np.repeat(base + lengths, lengths))
    ranks.finish()
    best, source = longest_previous(ranks)
    jumps = np.maximum(best, 1).tolist()
    borders, blocks = [], []
    for d, (at, end) in enumerate(zip(base.tolist(), (base + lengths).tolist(), strict=True)):
        before = 0
        while at < end:
            step = jumps[at]
            borders.append((at, before, step, d))
            if step >= LEAST + 2:
                blocks.append((d, at, step))
            at, before = at + step, step
        borders.append((end, before, 0, d))
    b, before, step, d = np.array(borders, np.int64).T
    found = []
    # Main: a run over a border has a whole period right of it (of at most the block) or left of it
    for x, p in _candidates(b, np.minimum(step, (base + lengths)[d] - b)):
        found += _around(ranks, x, p)
    for x, p in _candidates(b, np.minimum(before + step, b - base[d])):
        found += _around(ranks, x - p, p)
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    # multiples of a period give the same stretch: the smallest period counts
    rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))] if len(rows) else rows
    out: dict[int, list] = defaultdict(list)
    for doc, row in zip(np.searchsorted(base, rows[:, 0], "right") - 1, rows.tolist(), strict=True):
        out[int(doc)].append(tuple(row))
    for doc, at, step in blocks:
        if doc in out:
            _copied(out[doc], int(source[at]), at, step)
    return {int(kept[doc]): [(s - int(base[doc]), e - int(base[doc]), p) for s, e, p in runs] for doc, runs in out.items()}


def _copied(runs: list[tuple[int, int, int]], source: int, at: int, step: int) -> None:
    """Runs inside the block's earlier occurrence lie in the block, too.  ``runs`` stay sorted by start; where the two
    overlap, a copy is copied in its turn."""
    shift, k = at - source, bisect_right(runs, (source + 1,))
    while k < len(runs) and runs[k][0] < source + step:
        s, e, p = runs[k]
        if e < source + step:
            row = (s + shift, e + shift, p)
            i = bisect_right(runs, row)
            if i == 0 or runs[i - 1] != row:
                insort(runs, row)
        k += 1


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's repeats: for a tenth of the documents (by crc32 of the id), which word stands at each place."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


#: Result of a document: columns and types.
FIELDS = [("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()), ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    start, end, period = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
    kept = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        kept[s + p] += 1
        kept[e] -= 1
    kept = (np.cumsum(kept[:-1]) == 0).tolist()
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in sorted(runs, key=lambda r: (r[0], r[2])))
    rest = b" ".join(w for w, k in zip(words, kept, strict=True) if k)
    return len(runs), start, end - start, period, 1000 * (end - start) // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def digests(texts: list[bytes | None], ids: list[int | None] | None = None) -> list[tuple]:
    """The result columns (``FIELDS``) of each text; with ``ids``, of the texts with the contract's repeats."""
    number = defaultdict(count().__next__)
    docs, letters = [], []
    for k, text in enumerate(texts):
        words = text.split() if text else []
        place = planted(len(words), ids[k]) if ids is not None else None
        if place is not None:
            words = [words[i] for i in place.tolist()]
        docs.append(words)
        letters.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    lengths = np.array([len(w) for w in docs], np.int64)
    ends = np.cumsum(lengths)
    flat = np.concatenate(letters) if letters else np.zeros(0, np.int64)
    flat = flat + np.repeat(np.arange(len(docs)) * (len(number) + 1), lengths)
    runs = all_runs(flat, ends - lengths, ends)
    return [_digest(words, runs.get(k, [])) for k, words in enumerate(docs)]


def runs(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """Runs of words ``[^\\x20\\x09-\\x0D]+`` in each whole text: stretches with a smallest period q and at least
    max(12, 2q) words that no neighbouring word extends.

    Returns ``doc_id``, ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``; ties:
    smallest start, then period; nulls where there is none), ``runs_sha256``, ``collapsed_sha256`` (of the text without
    what runs repeat after their first period) and ``rest`` (all other columns but the text).  ``repeats`` plants the
    contract's repeats first; a null id has none.  Rows are documents; repeated rows give repeated results.  A null,
    empty or blank text has no runs.  An empty table gives no rows.

    Documents aren't shuffled.  A worker holds about 2 MB of texts, or one longer text, with 4 bytes a word for each
    doubling of its longest repeat and about 100 bytes a word beside."""
    base = docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest"))
    schema = T.StructType([base.schema["doc_id"], *[T.StructField(n, t) for n, t in FIELDS], base.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            rows = digests(texts, batch.column("doc_id").to_pylist() if repeats else None)
            columns = [pa.array(c, pa.string() if isinstance(t, T.StringType) else pa.int64()) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("rest")], names=schema.names)

    return base.mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(tables(spark, sf_dir, "documents").select("doc_id", "text"), repeats=True).drop("rest")
