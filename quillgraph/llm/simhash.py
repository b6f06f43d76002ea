"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, others, sifted, slices, tables
from .components import connected_components

SHINGLE, SEED = 3, 42
FAN = 16
#: Codes of a set of shingles, shingles in a code, and bits of the fingerprint that candidates are measured by.
CODES, SAMPLE, WIDE = 10, 4, 1_024
#: Four standard errors of the wide fingerprint's estimate: what it puts further below a threshold is under it.
MARGIN = 0.12
#: Sets from which a shared term counts as frequent, how many such terms are known at most, and the one text in so many
#: that tells it.
HOT, HOT_TERMS, ONE_IN = 100, 1 << 20, 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, 65,536 at a time: neither all shingles of a long text nor a
    large bit matrix exist at once."""
    found = text.translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    for i in range(0, max(1, len(found) - size + 1) if found else 0, 1 << 16):
        part = found[i : i + (1 << 16) + size - 1]
        yield np.array([digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(min(size, len(found)))))], dtype=">u8")


def _majority(pieces: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in pieces:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    return _majority(shingles(text, size))


def _mixed(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "big"), seed) for i in range(n)], dtype=np.uint64)


_XOR, _TIMES = _mixed(CODES * SAMPLE, 1), _mixed(CODES * SAMPLE, 2) | np.uint64(1)
_FLIPS = np.where(np.stack([_mixed(WIDE, 3), _mixed(WIDE, 4)]) >> np.uint64(63), 1.0, -1.0)
_HADAMARD = np.array([[(-1.0) ** (i & j).bit_count() for j in range(32)] for i in range(32)])


def sampled_codes(terms: np.ndarray) -> np.ndarray:
    """``CODES`` codes of a set of shingle hashes, each of ``SAMPLE`` shingles that a seed draws by least hash.  Sets of
    Jaccard similarity s share a given code with probability s ** SAMPLE; sets without a common shingle share none."""
    least = np.full(CODES * SAMPLE, _ALL)
    for i in range(0, len(terms), 4_096):
        least = np.minimum(least, ((terms[i : i + 4_096, None] ^ _XOR) * _TIMES).min(axis=0))
    rows = least.astype(">u8").reshape(CODES, SAMPLE)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A SimHash of ``WIDE`` bits, as longs, for each set of shingle hashes: hashes are dealt with signs to ``WIDE`` cells,
    and the bits are the signs of the cells after two randomised Hadamard transforms."""
    cells = np.stack([np.bincount((h & np.uint64(WIDE - 1)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), WIDE) for h in sets])
    for flips in _FLIPS:
        cells = (_HADAMARD @ (cells * flips).reshape(-1, 32, 32) @ _HADAMARD).reshape(-1, WIDE)
    return np.packbits(cells > 0, axis=1).view(np.int64)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the reflected Gray code."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """A tree over masked bit patterns in Gray order.  An entry is a pattern and the mask of the bits that it fixes
    (a code fixes all).  A node above 16 neighbours fixes the bits that all of them share; below it, these bits count
    no more.  A search adds up differences from the top and drops a node with all below it as soon as they exceed the
    limit."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(patterns), _ALL) if masks is None else masks
        self.levels = [(patterns, masks)]
        while len(patterns) > FAN:
            starts = np.arange(0, len(patterns), FAN)
            ones, zeros = np.bitwise_and.reduceat(patterns | ~masks, starts), np.bitwise_and.reduceat(~patterns | ~masks, starts)
            fixed = np.bitwise_and.reduceat(masks, starts)
            patterns, masks = ones & fixed, (ones | zeros) & fixed
            self.levels.append((patterns, masks))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs that differ in at most ``limit`` of the entry's fixed bits."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(queries)), top)
        e = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            patterns, masks = self.levels[depth]
            new = masks[e]
            if depth < len(self.levels) - 1:
                new = new & ~self.levels[depth + 1][1][e // FAN]
            spent = spent + np.bitwise_count((queries[q] ^ patterns[e]) & new)
            keep = spent <= limit
            q, e, spent = q[keep], e[keep], spent[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                q, spent = np.repeat(q, FAN), np.repeat(spent, FAN)
                e = (e[:, None] * FAN + np.arange(FAN)).ravel()
                if (full := e < below).all():
                    continue
                q, e, spent = q[full], e[full], spent[full]
        return q, e


class Union:
    """Local union-find over numpy arrays: labels are least members."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:  # halve the paths
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def fingerprints(docs: DataFrame, size: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the text replaced by ``fp`` (a long with the bits of the fingerprint) and, where
    asked, ``sketch``: the number of distinct shingles, their sampled codes and their wide fingerprint; ``sign`` is a hash of the
    set of shingles."""
    schema = T.StructType([*docs.drop("text").schema.fields, T.StructField("fp", T.LongType())])
    if sketched:
        longs = T.ArrayType(T.LongType(), False)
        schema = T.StructType([*schema.fields, T.StructField("sign", T.LongType()), T.StructField("terms", T.LongType()), T.StructField("codes", longs), T.StructField("wide", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
                codes, sets = [], []
                for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                    if sketched:
                        pieces = list(shingles(text or b"", size))
                        codes.append(_majority(pieces))
                        sets.append(np.unique(np.concatenate(pieces)).astype(np.uint64) if pieces else np.zeros(0, np.uint64))
                    else:
                        codes.append(fingerprint(text or b"", size))
                kept.append(pa.array(np.array(codes, dtype=np.uint64).view(np.int64)))
                if sketched:
                    kept.append(pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)))
                    kept.append(pa.array([len(h) for h in sets], pa.int64()))
                    for rows in (np.stack([sampled_codes(h) for h in sets]), wide_fingerprints(sets)):
                        kept.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel())))
                yield pa.RecordBatch.from_arrays(kept, names=schema.names)

    made = docs.mapInArrow(run, schema)
    return made.withColumn("sketch", F.struct("terms", "codes", "wide")).drop("terms", "codes", "wide") if sketched else made


def candidates(nodes: DataFrame, limit: int, least: float) -> DataFrame:
    """Pairs ``(a, b, about)`` of ``nodes(sign, fp, sketch)`` whose sets of shingles may have a Jaccard similarity of
    ``least`` or more, with its estimate.

    Pairs come from the Gray-order index (fingerprints within ``limit`` bits) and from shared sampled codes: each member
    of a code's group meets two members that the code picks, so a group of any size costs two rows a member, and the next
    codes pick others.  The bits in which the wide fingerprints differ and the sizes of the sets tell their similarity
    with a standard error of 0.03 at 0.8; what is ``MARGIN`` below goes.
    """
    full = nodes.where("sketch.terms > 0").select("sign", "fp", "sketch")
    heads = cut(full.groupBy("fp").agg(F.min("sign").alias("head")))
    same = full.join(heads, "fp").where("sign <> head").select(F.col("sign").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fp"), limit)
    for c in ("a", "b"):
        near = near.join(heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")), c)
    each = full.select("sign", F.explode("sketch.codes").alias("code"))
    lot = F.col("sign").bitwiseXOR(F.col("code"))
    picks = each.groupBy("code").agg(F.min(lot).alias("one"), F.max(lot).alias("two")).where("one <> two")
    picks = cut(picks.select("code", *[F.col(c).bitwiseXOR(F.col("code")).alias(c) for c in ("one", "two")]))
    met = each.join(picks, "code").select(F.col("sign").alias("a"), F.explode(F.array("one", "two")).alias("b"))
    pairs = met.union(same).union(near.select("a_head", "b_head")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(full.select(F.col("sign").alias(c), F.struct("sketch.terms", "sketch.wide").alias(f"{c}_")), c)
    differ = sum(F.bit_count(F.col("a_.wide")[i].bitwiseXOR(F.col("b_.wide")[i])) for i in range(WIDE // 64))
    common = F.cos(differ * (math.pi / WIDE)) * F.sqrt(F.col("a_.terms") * F.col("b_.terms"))
    about = common / (F.col("a_.terms") + F.col("b_.terms") - common)
    return pairs.select("a", "b", about.alias("about")).where(F.col("about") >= least - MARGIN)


def _sets_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, made: Callable[[list[np.ndarray]], list[pa.Array]], kind: str) -> DataFrame:
    """``sign`` and what ``made`` gives, of type ``kind``, for each of the sets in ``pairs(a, b)``, from one text of each.
    Only what is made of the texts is shuffled, and only of such as may be wanted."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("sign")).distinct().join(nodes, "sign").select("sign", "least", F.col("mark").alias("of")))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["mark"], *T.StructType.fromDDL(kind).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set(t, size) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *made(sets)], names=schema.names)

    told = sifted(docs, F.xxhash64("mark", "doc_id"), wanted, F.xxhash64("of", "least"))
    sets = told.where("hit").select("doc_id", "mark", "text").mapInArrow(run, schema)
    # a text that many rows have is spread by the ids, of which one is wanted
    found = sets.join(wanted, (F.col("mark") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return cut(found.select("sign", *schema.names[2:]).dropDuplicates(["sign"]))


def _set(text: bytes | None, size: int) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    pieces = list(shingles(text or b"", size))
    return np.unique(np.concatenate(pieces)).astype(np.uint64) if pieces else np.zeros(0, np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as one column of lists of longs."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The ``pairs(a, b)`` of ``nodes(sign, least, mark)`` with a Jaccard similarity of ``least`` or more, counted from
    the shingles of one text of each.  ``docs(doc_id, text, mark)``."""
    sets = _sets_of(pairs, nodes, docs, size, lambda sets: [_lists(sets)], "terms array<long>")
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sign").alias(c), F.col("terms").alias(f"{c}_terms")), c)
    common = F.size(F.array_intersect("a_terms", "b_terms"))
    return pairs.where(common >= least * (F.size("a_terms") + F.size("b_terms") - common)).select("a", "b")


def bitmap(terms: np.ndarray) -> np.ndarray:
    """The low bits of a set's hashes as a bit map of twice to four times as many bits as hashes, 1,024 at least."""
    width = max(1_024, 1 << (2 * len(terms) - 1).bit_length() if len(terms) else 0)
    bits = np.zeros(width, bool)
    bits[(terms & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def possible(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The ``pairs(a, b)`` without such as bit maps of the sets tell to be under ``least``, so that few whole sets have to
    meet.  A bit that only one of two sets has stands for a shingle, at least, that the other hasn't: none that has
    ``least`` goes.  Arguments as of ``similar``; the sizes of two sets are at most a quarter apart."""
    maps = _sets_of(pairs, nodes, docs, size, lambda sets: [pa.array([len(x) for x in sets], pa.int32()), _lists([bitmap(x) for x in sets])], "size int, bits array<long>")
    for c in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("sign").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits")), c)
    # of two widths the larger is twice the smaller, and its halves are laid upon each other
    n = F.least(F.size("a_bits"), F.size("b_bits"))
    one, two = (F.when(F.size(c) == n, F.col(c)).otherwise(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseOR(y))) for c in ("a_bits", "b_bits"))
    pairs = pairs.select("a", "b", "a_size", "b_size", one.alias("one"), two.alias("two"))
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
    common = F.least(F.col("a_size") - only("one", "two"), F.col("b_size") - only("two", "one"))
    return pairs.where(common >= least * (F.col("a_size") + F.col("b_size") - common) - 1e-6).select("a", "b")


def frequent_terms(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that about ``HOT`` texts or more have, as one text in ``ONE_IN`` tells; the most frequent if there are too
    many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set(t, size) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["term"])

    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).select("text")
    counts = drawn.mapInArrow(run, "term long").groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, HOT // ONE_IN))
    return np.sort(counts.orderBy(F.desc("n"), "term").limit(HOT_TERMS).select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def left_over(docs: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, least: float) -> DataFrame:
    """All pairs ``(a, b)`` of ``nodes(sign, least, mark)`` in different classes of ``roots(node, root)`` that may have a
    Jaccard similarity of ``least`` or more: none that has is left out.  ``docs(doc_id, text, mark)``.

    A set of n shingles has ``least`` of them in common with every set that it is similar to, so the first
    ``n - ceil(least * n) + 1`` of both, in any one order, have a term in common, and behind the first such term both have
    enough terms left.  The order is by hash, ``frequent_terms`` last: it decides what this costs, not what is found."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_terms(docs, size))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for batch in slices(batches):
            seen: dict[int, tuple[int, np.ndarray]] = {}
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                terms = _set(text, size)
                sign = xxhash.xxh64_intdigest(terms.tobytes())
                if not len(terms) or sign in seen:
                    continue
                total = len(terms)
                if len(last):
                    rank = np.minimum(np.searchsorted(last, terms), len(last) - 1)
                    terms = terms[np.argsort(last[rank] == terms, kind="stable")]
                seen[sign] = total, terms[: total - math.ceil(least * total - 1e-9) + 1].copy()
            if seen:
                signs = pa.array(np.array(list(seen), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([signs, pa.array([n for n, _ in seen.values()], pa.int32()), _lists([t for _, t in seen.values()])], names=["sign", "size", "terms"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last term, which may go on in the next batch
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            if held and held[0][0, 0] != rows[0, 0]:
                yield from paired(np.concatenate(held, axis=1))
                held = []
            begin = int(np.searchsorted(rows[0], rows[0, -1]))
            if begin:
                yield from paired(np.concatenate([*held, rows[:, :begin]], axis=1))
                held = []
            held.append(rows[:, begin:])
        if held:
            yield from paired(np.concatenate(held, axis=1))

    def paired(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        term, root, sign, total, place = rows[:, np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))]
        at, step = np.arange(len(term)), 0
        while len(at):  # each row meets the next row of its term, then the one after that, and so on
            step += 1
            at = at[at + step < len(term)]
            at = at[term[at] == term[at + step]]
            x, y = at, at + step
            common = np.minimum(total[x] - place[x], total[y] - place[y])
            keep = (root[x] != root[y]) & (common >= least / (1 + least) * (total[x] + total[y]) - 1e-6)
            keep &= np.minimum(total[x], total[y]) >= least * np.maximum(total[x], total[y]) - 1e-6
            if keep.any():
                a, b = sign[x[keep]], sign[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    sets = docs.select("text").mapInArrow(prefixes, "sign long, size int, terms array<long>")
    sets = sets.join(roots.select(F.col("node").alias("sign"), "root"), "sign", "left")
    rows = sets.select("sign", "size", F.coalesce("root", "sign").alias("root"), F.posexplode("terms").alias("place", "term")).select("term", "root", "sign", "size", "place")
    pairs = rows.repartition("term").sortWithinPartitions("term", "root", "sign").mapInArrow(met, "a long, b long")
    return possible(cut(pairs.distinct()), nodes, docs, size, least)


def links(codes: DataFrame, limit: int = 2, block: int = 8_192, many: int = 8_192, least_blocks: int = 64, group: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between different codes such that codes within ``limit`` bits, and no others, end in one
    component.  ``codes(fp)`` are distinct.

    The codes are dealt in Gray order to blocks of equal size whatever their distribution.  The upper tree, over the
    blocks' shared bit patterns, is broadcast: 24 bytes for each ``block`` codes, and past ``many`` blocks for each 8
    times as many, so a trillion codes take under 400 MB.  It sends each code to the blocks before its own that it can
    reach; there a tree over the block's codes finds its partners.  A block's queries come in groups of ``group`` source
    blocks, so that no task gets more than ``group`` blocks' codes, and stream through it; a group that asks nothing
    gets no copy of the block.  A block answers with one edge for each linked code, never with all pairs.
    """
    spark = codes.sparkSession
    n = codes.count()
    parts = max(least_blocks, min(many, math.ceil(n / block)), math.ceil(n / (8 * block)))
    # Gray rank: the parity of each bit with all above it; the top bit is flipped so that signed order is unsigned order
    ranked = codes.withColumn("rank", F.col("fp"))
    for k in (1, 2, 4, 8, 16, 32):
        ranked = ranked.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", k)))
    ranked = ranked.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    dealt = cut(ranked.repartitionByRange(parts, "rank").select("fp", F.spark_partition_id().alias("blk")))
    upper = dealt.groupBy("blk").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).orderBy("blk").collect()
    table = spark.sparkContext.broadcast([np.array([r[i] for r in upper], dtype=np.int64) for i in range(3)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, ones, some = table.value
        ones, some = ones.view(np.uint64), some.view(np.uint64)
        tree = GrayIndex(ones, ~(ones ^ some))
        for batch in batches:
            fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "blk"))
            for i in range(0, len(fp), 2_048):
                mine, at = fp[i : i + 2_048], own[i : i + 2_048]
                q, e = tree.search(mine.view(np.uint64), limit)
                to = blk[e]
                keep = to < at[q]
                q, to = q[keep], to[keep]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array((at[q] // group).astype(np.int32)), pa.array(mine[q]), pa.array(np.ones(len(q), bool))], names=["blk", "part", "fp", "asks"])

    kind = "blk int, part int, fp long, asks boolean"
    asking = cut(dealt.mapInArrow(route, kind))
    # a block's codes go to the groups that ask it; its own group also ties them to each other
    home = dealt.select("blk", F.floor(F.col("blk") / group).cast("int").alias("part"))
    wanted = asking.select("blk", "part").union(home).distinct()
    rows = dealt.join(wanted, "blk").select("blk", "part", "fp", F.lit(False).alias("asks")).unionByName(asking)
    rows = rows.repartition("blk", "part").sortWithinPartitions("blk", "part", "asks")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, queries in _groups(batches):
            edges = _tied(key[1] == key[0] // group, queries, limit)
            for a, b in edges:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(answer, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple[np.ndarray, bool]]]]:
    """Consecutive runs of one (blk, part) as ((blk, part), pieces of (codes, whether they ask)); pieces stream."""
    pieces = _pieces(batches)
    head = next(pieces, None)
    while head is not None:
        key = head[0]

        def own(first=head, key=key):
            nonlocal head
            piece = first
            while piece is not None and piece[0] == key:
                yield piece[1], piece[2]
                piece = next(pieces, None)
            head = piece

        run = own()
        yield key, run
        for _ in run:
            pass


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, bool]]:
    for batch in batches:
        blk, part, fp, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("blk", "part", "fp", "asks"))
        ends = np.flatnonzero((blk[1:] != blk[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1 if len(blk) else []
        for i, j in zip([0, *ends], [*ends, len(blk)], strict=True):
            if j > i:
                yield (int(blk[i]), int(part[i])), fp[i:j].view(np.uint64), bool(asks[i])


def _tied(home: bool, pieces: Iterator[tuple[np.ndarray, bool]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, tree, union, codes = [], None, None, None
    for got, asks in pieces:
        if not asks:
            held.append(got)
            continue
        if tree is None:
            tree, union, codes = _planted(held)
        for i in range(0, len(got), 1_024):
            mine = got[i : i + 1_024]
            q, e = tree.search(mine, limit)
            if len(q):
                asked, first = np.unique(q, return_index=True)
                union.tie(e, e[first][np.searchsorted(asked, q)])  # all partners of one query are one component
                yield mine[asked], codes[e[first]]
    if tree is None:
        if not (home and held):
            return
        tree, union, codes = _planted(held)
    if home:
        for i in range(0, len(codes), 1_024):
            q, e = tree.search(codes[i : i + 1_024], limit)
            union.tie(q + i, e)
    if len(joined := np.flatnonzero(union.label != np.arange(len(codes)))):
        yield codes[joined], codes[union.label[joined]]


def _planted(held: list[np.ndarray]) -> tuple[GrayIndex, Union, np.ndarray]:
    codes = np.concatenate(held) if held else np.zeros(0, np.uint64)
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    return GrayIndex(codes), Union(len(codes)), codes


def near_duplicates(docs: DataFrame, limit: int = 2, size: int = SHINGLE) -> DataFrame:
    """The class of near-duplicates of each document: fingerprints of ``size``-word shingles within ``limit`` bits are
    linked.

    Returns ``doc_id, fp, component_id`` (the smallest doc_id that links reach, the document's own included),
    ``rest`` (all other columns but the text) and ``root`` (a fingerprint that names the class, ids or not).

    Rows are documents; equal texts have equal fingerprints and are one class, so repeated rows too.  A null, empty or
    blank text has fingerprint 0 and is linked like any other.  Null doc_ids take part and are never the smallest,
    unless a class has no other.  An empty table gives no rows.

    Documents are first reduced to distinct fingerprints (partial sums: a group of copies is one row a task).  Of a very
    long text a worker holds the words (about 60 bytes each) and 65,536 shingles at a time.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest")), size))
    codes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _classes(marked, codes, "fp", connected_components(links(codes.select("fp"), limit))).select("doc_id", "fp", "component_id", "rest", "root")


def similar_documents(docs: DataFrame, limit: int = 3, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The class of near-duplicates of each document: texts are linked whose sets of ``size``-word shingles have a Jaccard
    similarity of ``similarity`` or more.

    Candidates come from the index of fingerprints within ``limit`` bits and, since 64 bits can't tell such a similarity,
    from sampled codes (``candidates``).  **Every link is counted from the shingles themselves**; candidates that can't
    tie two classes any more are not: first each text's best candidate is counted, then those between different classes.
    At last, since codes are drawn and an estimate may be low, texts of different classes meet by the prefixes of their
    sets, which leaves no pair out (``left_over``).

    Returns ``doc_id, fp, component_id, rest, root`` as ``near_duplicates`` does; ``root`` is a hash of a set of shingles.
    Rows are documents; texts with the same set of shingles are one class, so repeated rows and all texts without words.
    Null doc_ids and empty tables are as there.  A worker also holds 8 bytes a shingle of a text; each document writes
    about 220 bytes, and texts that have candidates are read once more.
    """
    mark = F.xxhash64("text").alias("mark")
    marked = cut(fingerprints(docs.select("doc_id", "text", mark, others(docs, "doc_id", "text").alias("rest")), size, True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    nodes = marked.groupBy("sign").agg(first, F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))
    nodes = cut(nodes.select("sign", "fp", "sketch", F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark")))
    pairs = cut(candidates(nodes, limit, similarity))
    texts = docs.select("doc_id", "text", mark)
    both = pairs.union(pairs.select("b", "a", "about"))
    best = both.groupBy("a").agg(F.max(F.struct("about", "b")).alias("best")).select(F.least("a", "best.b").alias("x"), F.greatest("a", "best.b").alias("y")).distinct()
    roots = connected_components(similar(best.select(F.col("x").alias("a"), F.col("y").alias("b")), nodes, texts, size, similarity))
    apart = pairs.select("a", "b")
    for c in ("a", "b"):
        apart = apart.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    apart = cut(apart.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    more = cut(similar(apart, nodes, texts, size, similarity))
    if not more.isEmpty():
        roots = connected_components(more.union(roots.select("node", "root")))
    rest = cut(left_over(texts, nodes, roots, size, similarity))
    more = cut(similar(rest, nodes, texts, size, similarity))
    if not more.isEmpty():
        roots = connected_components(more.union(roots.select("node", "root")))
    return _classes(marked, nodes, "sign", roots).select("doc_id", "fp", "component_id", "rest", "root")


def _classes(marked: DataFrame, codes: DataFrame, by: str, roots: DataFrame) -> DataFrame:
    """``marked`` with ``component_id`` and ``root``: ``codes(<by>, least)`` are tied by ``roots(node, root)``."""
    codes = codes.select(F.col(by).alias("code"), "least")
    placed = codes.join(roots, codes.code == roots.node, "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    # only classes of several codes need their least document from elsewhere
    tied = placed.where("root <> code").groupBy("root").agg(F.min("least").alias("other"))
    tied = tied.join(codes.select(F.col("code").alias("root"), F.col("least").alias("mine")), "root").select("root", F.least("other", "mine").alias("first"))
    classes = cut(placed.join(tied, "root", "left").select("code", F.coalesce("first", "least").alias("component_id"), "root"))
    return marked.join(classes, marked[by] == classes.code)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
