"""Suffix-array dedup: bytes under a long string that also starts in an earlier document, by merging shard
Burrows-Wheeler transforms.

Suffixes that share ``length`` bytes have to meet; all suffixes of the corpus need not.  Every string of ``length`` bytes
holds an anchor, the least hashed k-mer in it, which depends on these bytes only, so equal strings have equal anchors:

1. one pass over the texts finds the anchors (one in about 18 bytes) with the strings that each stands for: their
   union is the anchor's context;
2. anchors meet by hash.  An occurrence whose context seems to be an earlier document's asks for its bytes and that
   document's (neighbouring contexts as one region); contexts that differ but agree in a further 16 bytes or so on one
   side ask for theirs.  Nothing is decided here: hashes only say which bytes have to be compared;
3. the bytes asked for meet by region of the earlier document, or by anchor and side.  Tasks split them into shards,
   build the shards' transforms and merge them by iterative interleave refinement; the intervals whose suffixes share
   ``length`` bytes are the repeats, and each byte that is removed comes from such an interval;
4. the places found go back to their documents, which are cut in one pass.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bwt import repeated
from .common import cut, others, shared_dir, slices, tables

KMER = 16
_MULTIPLY = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of texts that are hashed at once (about 100 bytes of memory each), and the margin around a part of a longer
#: text within which the bytes beside an anchor are seen.
PIECE, MARGIN = 1 << 20, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


class _Rolling:
    """Hashes of all substrings of any one length, by doubling."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _VALUES[data]}

    def of(self, n: int) -> np.ndarray:
        have, out, at = self.by, None, 0
        for k in (1 << b for b in reversed(range(n.bit_length())) if n >> b & 1):
            while k not in have:
                m = max(x for x in have if x < k)
                h = have[m]
                have[2 * m] = h[:-m] * np.uint64(pow(_MULTIPLY, m, 1 << 64)) + h[m:]
            part = have[k][at:]
            out = part if out is None else out[: len(part)] * np.uint64(pow(_MULTIPLY, k, 1 << 64)) + part[: len(out)]
            at += k
        return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, within: tuple[int, int] | None = None) -> dict[str, np.ndarray]:
    """The anchors of texts that stand one after another in ``data``, each ``ends`` marking a byte between texts; of
    strings that start ``within`` a range only, if one is given.

    Arrays: ``key`` (hash of the anchor), ``context`` (hash of its context and its place in it), ``at`` (the anchor's
    place), ``first`` and ``last`` (the first bytes of its first and last string), and 10 bits each of the hashes of
    what follows and precedes the anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("key", "context", "at", "first", "last", "after", "ahead")}
    rolling, width = _Rolling(data), length - KMER + 1
    kmers = _mix(rolling.of(KMER))
    # the least k-mer of each string, and its first place there, by doubling
    least, place, s = kmers, np.arange(len(kmers), dtype=np.int32), 1
    steps = []
    while s * 2 <= width:
        steps.append(s)
        s *= 2
    if s < width:
        steps.append(width - s)
    for d in steps:
        a, b = least[:-d], least[d:]
        right = b < a
        least, place = np.where(right, b, a), np.where(right, place[d:], place[:-d])
    least, place = least[:n], place[:n]
    inside = np.ones(n, bool)  # strings that lie in one text
    for end in ends:
        inside[max(0, end - length + 1) : end + 1] = False
    if within:
        inside[: within[0]] = inside[within[1] :] = False
    new = np.concatenate(([True], place[1:] != place[:-1])) | np.concatenate(([True], ~inside[:-1]))
    first = np.flatnonzero(inside & new)
    stop = np.concatenate((new[1:] | ~inside[1:], [True]))
    last = np.flatnonzero(inside & stop)
    at = place[first].astype(np.int64)
    whole = rolling.of(length)
    context = _mix(_mix(whole[first]) + np.uint64(_MULTIPLY) * whole[last] + ((at - first) * 64 + (last - first)).astype(np.uint64))
    return {"key": least[first].view(np.int64), "context": context.view(np.int64), "at": at, "first": first, "last": last, "after": _bits(kmers, at + KMER), "ahead": _bits(kmers, at - KMER)}


def _bits(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where((at >= 0) & (at < len(hashes)), hashes[np.clip(at, 0, len(hashes) - 1)] >> np.uint64(54), np.uint64(0)).astype(np.int64)


def _spans(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return first << 32 | stop


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


#: Bytes of an earlier document's text that one group of copies is compared with.
REGION = 1 << 14
#: kind 0: an anchor; 1: a context that seems to be that of ``owner``, ``delta`` bytes before.
_ROW = "kind int, key long, context long, doc long, packed long, owner long, delta long"
#: kind 1: such a context, a to b; 2: bytes a to b to compare under ``key``.
_MET = "kind int, key long, doc long, a long, b long, owner long, delta long"
_ASK = "doc long, key long, a long, b long"


def _frame(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n.split()[0] for n in names.split(", ")])


def _scan(length: int, bits: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc").to_numpy(zero_copy_only=False), _texts(batch)
            i = 0
            while i < len(texts):
                if len(texts[i]) > PIECE:
                    # parts of a long text: contexts at their borders are cut, which a comparison of bytes makes good
                    for a in range(0, len(texts[i]) - length + 1, PIECE):
                        start = max(0, a - MARGIN)
                        part = texts[i][start : a + PIECE + length - 1 + MARGIN]
                        yield from _one_piece(ids[i : i + 1], [part], length, bits, (a - start, a - start + PIECE), start)
                    i += 1
                    continue
                j, size = i, 0
                while j < len(texts) and size + len(texts[j]) <= PIECE:
                    size += len(texts[j]) + 1
                    j += 1
                yield from _one_piece(ids[i:j], texts[i:j], length, bits)
                i = j

    return run


def _one_piece(ids: np.ndarray, texts: list[bytes], length: int, bits: int = 0, within: tuple[int, int] | None = None, shift: int = 0) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    found = anchors(np.frombuffer(b"\0".join([*texts, b""]), np.uint8), ends, length, within)
    which = np.searchsorted(ends, found["first"])
    base = np.concatenate(([0], ends[:-1] + 1))[which] if len(texts) else ends
    doc = ids[which]
    order = np.lexsort((doc, found["context"], found["key"]))
    key, context, doc = found["key"][order], found["context"][order], doc[order]
    first, last, at = ((found[k] - base + shift)[order] for k in ("first", "last", "at"))
    start = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]))) if len(key) else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    least = doc[start][group] if len(key) else doc
    gone = doc >> bits != least >> bits
    packed = np.where(gone, _spans(first, last + length), at << 32 | (at - first) << 26 | (at - last) << 20 | found["after"][order] << 10 | found["ahead"][order])
    delta = first - first[start][group] if len(key) else first
    # what is known here only passes through the exchange, so it is spread by document
    yield _frame(_ROW, gone.astype(np.int32), np.where(gone, doc, key), np.where(gone, 0, context), doc, packed, np.where(gone, least, 0), np.where(gone, delta, 0))


def _settle(length: int, shift: int):
    """Rows in order of (kind, key, context, doc): which bytes have to be compared."""
    half = (length - KMER) // 2

    def whole(key, context, doc, packed):
        owner = doc >> shift
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_context = new_key | np.concatenate(([True], context[1:] != context[:-1]))
        anchor, group = np.cumsum(new_key) - 1, np.cumsum(new_context) - 1
        starts = np.flatnonzero(new_key)
        several = (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts))[anchor]
        at, low, high = packed >> 32, packed >> 26 & 63, packed >> 20 & 63
        gone = np.flatnonzero(owner != owner[new_context][group])
        if len(gone):
            first = at - low
            yield _frame(_MET, np.full(len(gone), 1, np.int32), doc[gone], doc[gone], first[gone], (at - high + length)[gone], doc[new_context][group][gone], (first - first[new_context][group])[gone])
        # one row of each context of anchors with several contexts, by side
        mixed = several & (owner == owner[new_context][group]) & (np.bincount(anchor, new_context)[anchor] > 1)
        for side, has, bits in ((0, high < half, packed >> 10 & 1023), (1, low >= half, packed & 1023)):
            k = np.flatnonzero(mixed & has)
            if not len(k):
                continue
            tag = anchor[k] << 10 | bits[k]
            order = np.argsort(tag, kind="stable")
            k, tag = k[order], tag[order]
            begin = np.concatenate(([True], tag[1:] != tag[:-1]))
            cluster, at0 = np.cumsum(begin) - 1, np.flatnonzero(begin)
            differ = (np.minimum.reduceat(owner[k], at0) != np.maximum.reduceat(owner[k], at0))[cluster]
            k = k[differ]
            if len(k):
                # strings with the anchor in their first half share what follows it, the others what precedes it
                a = (at - np.minimum(low, half - 1) if side == 0 else at - low)[k]
                b = (at - high if side == 0 else at - np.maximum(high, half))[k] + length
                meet = _mix(key[k].view(np.uint64) + ((bits[k] << 1 | side) + 1).astype(np.uint64) * np.uint64(_MULTIPLY)).view(np.int64)
                yield _frame(_MET, np.full(len(k), 2, np.int32), meet, doc[k], a, b, np.zeros(len(k), np.int64), np.zeros(len(k), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            kind, *rest, owner, delta = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "context", "doc", "packed", "owner", "delta"))
            passing = kind == 1
            if passing.any():
                doc, packed = rest[2][passing], rest[3][passing]
                yield _frame(_MET, kind[passing], doc, doc, packed >> 32, packed & 0xFFFFFFFF, owner[passing], delta[passing])
            rest = [x[kind == 0] for x in rest]
            if not len(rest[0]):
                continue
            cut = np.searchsorted(rest[0], rest[0][-1])  # the last key may go on in the next batch
            if cut or (held and held[-1][0][-1] != rest[0][0]):
                done = [*held, [x[:cut] for x in rest]]
                if sum(len(d[0]) for d in done):
                    yield from whole(*(np.concatenate([d[i] for d in done]) for i in range(4)))
                held = []
            held.append([x[cut:] for x in rest])
        if held:
            yield from whole(*(np.concatenate([d[i] for d in held]) for i in range(4)))

    return run


def _regions(length: int, region: int = REGION):
    """Rows in order of (doc, kind, owner, delta, a): contexts of one owner and shift that overlap or touch as one region,
    cut where the owner's text is cut, with the owner's side of it; what is asked for by key passes through."""

    def asked(doc, owner, delta, a, b) -> pa.RecordBatch:
        first, last = (a - delta) // region, np.maximum(a - delta, b - delta - length) // region
        n = last - first + 1
        i = np.repeat(np.arange(len(doc)), n)
        part = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        doc, owner, delta = doc[i], owner[i], delta[i]
        x, y = np.maximum(a[i] - delta, part * region), np.minimum(b[i] - delta, (part + 1) * region + length - 1)
        key = _mix(_mix(owner.view(np.uint64)) + part.astype(np.uint64) * np.uint64(_MULTIPLY)).view(np.int64)
        # the owner's side of a long region in steps of 256 bytes, so that copies that differ a little ask for the same
        far = y - x > 2_048
        own = np.unique(np.stack((owner, key, np.where(far, x & ~255, x), np.where(far, np.minimum(y + 255 & ~255, (part + 1) * region + length - 1), y))), axis=1)
        return _frame(_ASK, np.concatenate((doc, own[0])), np.concatenate((key, own[1])), np.concatenate((x + delta, own[2])), np.concatenate((y + delta, own[3])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last region, which may go on in the next batch
        for batch in batches:
            kind, *more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "doc", "a", "b", "owner", "delta"))
            if (direct := kind == 2).any():
                key, doc, a, b = (x[direct] for x in more[:4])
                yield _frame(_ASK, doc, key, a, b)
            _, doc, a, b, owner, delta = (x[~direct] for x in more)
            if held is not None:
                doc, owner, delta, a, b = (np.concatenate((h, x)) for h, x in zip(held, (doc, owner, delta, a, b), strict=True))
            if not len(doc):
                continue
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (delta[1:] != delta[:-1]) | (a[1:] > b[:-1])))
            begin = np.flatnonzero(new)
            doc, owner, delta, a, b = doc[begin], owner[begin], delta[begin], a[begin], np.maximum.reduceat(b, begin)
            held = [x[-1:] for x in (doc, owner, delta, a, b)]
            if len(doc) > 1:
                yield asked(doc[:-1], owner[:-1], delta[:-1], a[:-1], b[:-1])
        if held is not None:
            yield asked(*held)

    return run


def _fetch(length: int, limit: int = 1 << 23):
    """The bytes asked for, about ``limit`` of them at a time, as slices of the column's buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            asks = batch.column("asks")
            of = np.repeat(np.arange(len(texts)), pc.list_value_length(asks).to_numpy(zero_copy_only=False))
            flat = asks.flatten()
            key, a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("key", "a", "b"))
            b = np.minimum(b, (offsets[1:] - offsets[:-1])[of])
            good = b - a >= length
            key, a, size, of = key[good], a[good], (b - a)[good], of[good]
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[of]
            upto, i = np.cumsum(size), 0
            while i < len(key):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, "right")))
                n = size[i:j]
                ends = np.concatenate(([0], np.cumsum(n)))
                got = data[np.repeat(offsets[of[i:j]] + a[i:j] - ends[:-1], n) + np.arange(ends[-1])]
                parts = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(got)])
                yield _frame("key, part, doc, first", key[i:j], parts, doc[i:j], a[i:j])
                i = j

    return run


def _compare(length: int, shift: int, chunk: int = 1 << 20):
    """Merge the transforms of the parts that meet, whole keys at a time, about ``chunk`` bytes together.  A key that
    goes on over batches and fills more than a chunk is merged piece by piece against what :class:`_Firsts` carries."""

    def told(doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Strings that follow each other byte by byte as one span."""
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))
            last = np.concatenate((new[1:], [True]))
            yield _frame("doc, packed", doc[new], _spans(start[new], start[last] + length))

    def merged(rows: list) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([r[0] for r in rows])
        doc, first = (np.concatenate([r[i] for r in rows]) for i in (2, 3))
        strings = [s for r in rows for s in r[1]]
        # keys of one document have nothing to compare
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.repeat(np.arange(len(begin)), np.diff([*begin, len(key)]))
        owner = doc >> shift
        keep = np.flatnonzero((np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin))[run])
        if not len(keep):
            return
        which, offset = repeated([strings[i] for i in keep], owner[keep], length)
        which = keep[which]
        yield from told(doc[which], first[which] + offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        hot, going = None, None  # the key that fills more than a chunk and may go on, and what is carried of it
        for batch in batches:
            key, doc, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "first"))
            part = batch.column("part").to_pylist()
            i = 0
            if going is not None and len(key):
                i = int(np.searchsorted(key != hot, True)) if key[-1] != hot else len(key)
                yield from told(*going.add(part[:i], doc[:i], first[:i]))
                if i < len(key):
                    going = None
            while i < len(key):
                # as many whole keys as fit; a key that fills more than a chunk is compared whole all the same
                j = i
                while j < len(key) and size < chunk:
                    size += len(part[j]) + 1
                    j += 1
                while j < len(key) and size >= chunk and key[j] == key[j - 1]:
                    size += len(part[j]) + 1
                    j += 1
                held.append((key[i:j], part[i:j], doc[i:j], first[i:j]))
                if size >= chunk and j < len(key):
                    yield from merged(held)
                    held, size = [], 0
                elif size >= chunk:  # the batch ends here: the last key may go on in the next one
                    held, tail = _before_last_key(held)
                    if held:
                        yield from merged(held)
                    held, size = [tail], sum(map(len, tail[1])) + len(tail[1])
                    if size >= chunk:
                        hot, going = tail[0][0], _Firsts(length, shift, chunk)
                        yield from told(*going.add(*tail[1:]))
                        held, size = [], 0
                i = j
        if held and sum(len(r[0]) for r in held):
            yield from merged(held)

    return run


class _Firsts:
    """The strings of one key that have come so far, each once with its smallest owner, as pieces of parts in blocks
    of about two chunks.  A merge takes a chunk of new parts and one block, so its memory doesn't grow with the key;
    what is carried are the bytes of the key's different strings."""

    def __init__(self, length: int, shift: int, chunk: int):
        self.length, self.shift, self.chunk = length, shift, chunk
        self.blocks: list[tuple[list[bytes], np.ndarray]] = [([], np.zeros(0, np.int64))]

    def add(self, part: list[bytes], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, first byte) of each new string that a smaller owner has.  Parts come in order of their
        documents, so no carried string is ever met by a smaller owner."""
        docs, firsts, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while i < len(part):
            j, size = i, 0
            while j < len(part) and size < self.chunk:
                size += len(part[j]) + 1
                j += 1
            for found in self._piece(part[i:j], doc[i:j], first[i:j]):
                docs.append(found[0])
                firsts.append(found[1])
            i = j
        return np.concatenate(docs), np.concatenate(firsts)

    def _piece(self, part: list[bytes], doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for strings, owners in self.blocks:
            if not part:
                return
            n = len(strings)
            which, offset = repeated([*strings, *part], np.concatenate((owners, doc >> self.shift)), self.length)
            new = which >= n
            which, offset = which[new] - n, offset[new]
            yield doc[which], first[which] + offset
            part, doc, first = self._rest(part, doc, first, which, offset)
        # of equal strings of one owner one is enough: by their order they are told apart
        strings, owners = self.blocks[-1]
        if part:
            n = len(strings)
            which, offset = repeated([*strings, *part], np.arange(n + len(part)), self.length)
            new = which >= n
            part, doc, first = self._rest(part, doc, first, which[new] - n, offset[new])
        if sum(map(len, strings)) + len(strings) >= 2 * self.chunk:
            self.blocks.append(([], np.zeros(0, np.int64)))
            strings, owners = self.blocks[-1]
        self.blocks[-1] = [*strings, *part], np.concatenate((owners, doc >> self.shift))

    def _rest(self, part: list[bytes], doc: np.ndarray, first: np.ndarray, which: np.ndarray, offset: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces of parts over all strings but the given ones."""
        n = np.maximum(np.array([len(p) for p in part]) - self.length + 1, 0)
        base = np.cumsum(n) - n
        keep = np.ones(int(n.sum()), bool)
        keep[base[which] + offset] = False
        of = np.repeat(np.arange(len(part)), n)
        apart = of[1:] != of[:-1]
        a = np.flatnonzero(keep & np.concatenate(([True], ~keep[:-1] | apart))[: len(keep)])
        b = np.flatnonzero(keep & np.concatenate((~keep[1:] | apart, [True]))[: len(keep)])
        of = of[a]
        a, b = a - base[of], b - base[of] + self.length
        return [part[k][x:y] for k, x, y in zip(of, a, b, strict=True)], doc[of], first[of] + a


def _before_last_key(rows: list) -> tuple[list, tuple]:
    key = np.concatenate([r[0] for r in rows])
    cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
    part = [s for r in rows for s in r[1]]
    doc, first = (np.concatenate([r[i] for r in rows]) for i in (2, 3))
    return ([(key[:cut], part[:cut], doc[:cut], first[:cut])] if cut else []), (key[cut:], part[cut:], doc[cut:], first[cut:])


def _strip(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 22):
            kept, sizes, removed, runs = [], [], [], []
            for text, spans in zip(_texts(batch), batch.column("spans"), strict=True):
                at, out, lost, n = 0, [], 0, 0
                packed = np.sort(spans.values.to_numpy(zero_copy_only=False)) if spans.is_valid and len(spans) else ()
                if len(packed):
                    first, stop = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
                    new = np.concatenate(([True], first[1:] > stop[:-1]))
                    for a, b in zip(first[new], stop[np.concatenate((new[1:], [True]))], strict=True):
                        out.append(text[at:a])
                        lost, n, at = lost + int(b - a), n + 1, b
                kept.append(b"".join([*out, text[at:]]) if n else text)
                sizes.append(len(text))
                removed.append(lost)
                runs.append(n)
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), batch.column("rest")], names=schema.names)

    return run


def _numbered(base: DataFrame) -> tuple[DataFrame, int]:
    """``base`` with ``doc``, a number for each row in the order of doc_ids, null last; rows of one doc_id differ in the
    lowest bits only.  Returns how many bits these are."""
    ids = base.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct"), F.min("doc_id").alias("bottom"), F.max("doc_id").alias("top")).first()
    if ids.n == ids.distinct:
        return base.withColumn("doc", F.col("doc_id").cast("long")), 0
    # rows of one id are numbered in 64 parts, so that an id that many rows share isn't one task
    part = F.pmod(F.xxhash64("text"), F.lit(64))
    nth = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("text"))
    base = base.withColumn("part", part).withColumn("nth", nth.cast("long") * 64 + F.col("part"))
    bits = int(base.agg(F.max("nth")).first()[0]).bit_length()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((ids.top or 0) + 1))
    if max(abs(ids.bottom or 0), abs(ids.top or 0) + 1).bit_length() + bits > 62:
        raise ValueError("doc_ids and the number of rows that share one take over 62 bits together: renumber the documents")
    return base.withColumn("doc", F.shiftleft(key, bits) + F.col("nth")).drop("part", "nth"), bits


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each byte under a ``length``-byte string that also starts in a document with a smaller doc_id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay, binary, as a cut may
    fall inside a character) and ``rest`` (all other columns but the text).

    Rows are documents.  Rows of one doc_id are parts of one document: their common strings don't count as repeats,
    and each row keeps its own result.  A null text is empty and a null doc_id larger than all others.  Texts of under
    ``length`` bytes stay.  An empty table gives no rows.  Texts over 4 GB aren't supported (places take 32 bits).

    What is compared grows with what is repeated, not with the corpus; see the module's text for the plan.  Comparisons
    run when this is called: what has to be compared is written to the shared folder, and deleted when the places found
    are checkpointed.  A worker holds about 100 bytes for each byte of 1 MB of texts or parts, however many copies meet.
    """
    spark = docs.sparkSession
    base, shift = _numbered(docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest")))
    rows = base.select("doc", "text").where(F.octet_length("text") >= length).mapInArrow(_scan(length, shift), _ROW)
    met = rows.repartition("key").sortWithinPartitions("kind", "key", "context", "doc").mapInArrow(_settle(length, shift), _MET)
    asks = met.repartition("doc").sortWithinPartitions("doc", "kind", "owner", "delta", "a").mapInArrow(_regions(length), _ASK)
    place = f"{shared_dir(spark).rstrip('/')}/suffix-{uuid.uuid4().hex}"
    asks.write.parquet(place)
    asks = spark.read.schema(_ASK).parquet(place).groupBy("doc").agg(F.collect_set(F.struct("key", "a", "b")).alias("asks"))
    parts = base.select("doc", "text").join(asks, "doc").mapInArrow(_fetch(length), "key long, part binary, doc long, first long")
    # a key's parts arrive together, as many keys to a merge as fit a chunk
    found = parts.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_compare(length, shift), "doc long, packed long")
    spans = cut(found.groupBy("doc").agg(F.collect_list("packed").alias("spans")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    both = base.join(spans, "doc", "left").select("doc_id", "text", "spans", "rest")
    schema = T.StructType([base.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields, base.schema["rest"]])
    return both.mapInArrow(_strip(schema), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
