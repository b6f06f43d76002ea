"""A hashed maximum-entropy language model with a class-factored softmax.

A word is reached by four choices among 16: class, subclass, and two more within.  Each choice is a softmax whose logits are
the logarithm of the unigram shares plus weights of hashed features: the word before (a bigram), the two words before (a
trigram) and the word before the last (a skip).  So a word costs 64 logits whatever the vocabulary, and every distribution
sums to one.  Words beyond the 65,536 slots share 64 slots by their endings, and are told apart by their counts.

The model is trained by distributed gradient updates: every training document teaches all features, in one of three
rounds.  In a round each task takes AdaGrad steps over its documents from the weights of the round before; the
changes of each weight are averaged over tasks by how often the task used it.  Scoring runs in sparse batches of numpy: rows of the weight table are gathered by
the hashes of the features that are present.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, others, slices, tables

FAN, LEVELS = 16, 4
SLOTS = FAN**LEVELS
#: Number 0 ends a text; the next 64 stand for words without a slot, by their last two bytes; then words by frequency.
BUCKETS = 64
FIRST_WORD = 1 + BUCKETS
#: Words whose counts are broadcast; the counts of the others are joined.
COUNTED = 1 << 18
#: Rows of the weight table, each with the weights of one feature for the 16 choices of a node.
ROWS = 1 << 18
RATE, BATCH = 0.25, 4_096
#: Neighbours by which words are arranged: these many most frequent ones before a word, and as many after it.
NEIGHBOURS = 32
#: Tokens of a training task in a round; a sum of matrices takes so many at a time.
TASK_TOKENS, TOGETHER = 4_000_000, 64
#: Rounds of training, each over its share of the training rows.
ROUNDS = 3
#: Rows of a matrix that travel together.
BLOCK = 4_096
END = b"\n"
#: Nodes of the tree, level by level: 1, 16, 256, 4,096.
_BASE = np.array([0, 1, 17, 273], np.uint32)
NODES = 4_369
#: Bigram, skip and trigram features, with the levels that each has.
FEATURES = ((0, 1, 2, 3), (0, 1), (0, 1, 2))
_ONES = np.ones(FAN, np.float32)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(15))
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


class Model:
    """Weights, and the place of every number in the tree of choices."""

    def __init__(self, mass: np.ndarray, order: np.ndarray):
        """``mass``: the unigram weight of each number; ``order``: the numbers in the order of the tree's leaves."""
        self.slot = np.empty(SLOTS, np.uint32)
        self.slot[order] = np.arange(SLOTS, dtype=np.uint32)
        leaves = mass[order].astype(np.float64)
        parts = []
        for _ in range(LEVELS):
            inner = leaves.reshape(-1, FAN)
            whole = inner.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.log(inner / whole)
            parts.append(np.where(whole > 0, np.maximum(share, -30), -math.log(FAN)))
            leaves = whole[:, 0]
        self.prior = np.concatenate(parts[::-1]).astype(np.float32)
        self.weights, self.squares = np.zeros((ROWS, FAN), np.float32), np.zeros(ROWS, np.float32)

    def _rows(self, w: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, list[list[np.ndarray | None]], list[np.ndarray]]:
        """Of the words at..stop of ``w``, which has two ends before them: the nodes on each word's way, the rows of each
        feature by level (None where it has none), and the choices."""
        now, one, two = self.slot[w[at + 2 : stop + 2]], w[at + 1 : stop + 1].astype(np.uint32), w[at:stop].astype(np.uint32)
        two = np.where(one == 0, np.uint32(0), two)  # nothing is known from the text before
        a, b = (one + np.uint32(1)) * np.uint32(0x9E3779B1), (two + np.uint32(1)) * np.uint32(0x85EBCA77)
        contexts = (_mix(a), _mix(b ^ np.uint32(0x5BD1E995)), _mix(a ^ _mix(b)))
        nodes = [_BASE[k] + (now >> np.uint32(4 * (LEVELS - k))) for k in range(LEVELS)]
        steps = [(n + np.uint32(1)) * np.uint32(0xC2B2AE3D) for n in nodes]
        rows = [[(_mix(c + steps[k]) & np.uint32(ROWS - 1)).astype(np.intp) if k in levels else None for k in range(LEVELS)] for c, levels in zip(contexts, FEATURES, strict=True)]
        return nodes, rows, [((now >> np.uint32(4 * (LEVELS - k - 1))) & np.uint32(FAN - 1)).astype(np.intp) for k in range(LEVELS)]

    def _logits(self, node: np.ndarray, rows: list[np.ndarray | None], out: np.ndarray, more: np.ndarray) -> None:
        """Capped at 80, whose exponential single precision still holds."""
        self.prior.take(node.astype(np.intp), axis=0, out=out, mode="clip")
        for r in rows:
            if r is not None:
                self.weights.take(r, axis=0, out=more, mode="clip")
                out += more
        np.minimum(out, np.float32(80), out=out)

    def score(self, w: np.ndarray) -> np.ndarray:
        """log10 probability of each number, given those before it; ``w`` has two ends before the first."""
        n = len(w) - 2
        out, each = np.zeros(n), np.arange(BATCH)
        held, more = np.empty((BATCH, FAN), np.float32), np.empty((BATCH, FAN), np.float32)
        for at in range(0, n, BATCH):
            stop = min(n, at + BATCH)
            nodes, rows, choices = self._rows(w, at, stop)
            logits, total = held[: stop - at], np.zeros(stop - at, np.float32)
            for k in range(LEVELS):
                self._logits(nodes[k], [f[k] for f in rows], logits, more[: stop - at])
                total += logits[each[: stop - at], choices[k]]
                np.exp(logits, out=logits)
                total -= np.log(logits.sum(axis=1))  # unlike a product, the same wherever in the batch a row is
            out[at:stop] = total
        return out / math.log(10)

    def train(self, w: np.ndarray, used: np.ndarray, feature: int | None = None) -> None:
        """AdaGrad steps, one a batch, for the weights of all features together, or of one; those before it are in the
        logits then, as they are.  ``used`` counts how often each row took part."""
        taught = range(len(FEATURES)) if feature is None else (feature,)
        n, levels = len(w) - 2, sorted({k for f in taught for k in FEATURES[f]})
        slopes, more, each = np.empty((len(levels), BATCH, FAN), np.float32), np.empty((BATCH, FAN), np.float32), np.arange(BATCH)
        for at in range(0, n, BATCH):
            stop = min(n, at + BATCH)
            m = stop - at
            nodes, rows, choices = self._rows(w, at, stop)
            part = slopes[:, :m] if m == BATCH else np.empty((len(levels), m, FAN), np.float32)
            for i, k in enumerate(levels):
                logits = part[i]
                self._logits(nodes[k], [f[k] for f in rows[: taught[-1] + 1]], logits, more[:m])
                np.exp(logits, out=logits)
                logits *= (np.float32(1) / (logits @ _ONES))[:, None]
                logits[each[:m], choices[k]] -= 1
            own = np.concatenate([rows[f][k] for f in taught for k in FEATURES[f]])
            of = np.concatenate([each[:m] + levels.index(k) * m for f in taught for k in FEATURES[f]])
            order = np.argsort(own.astype(np.uint32))
            own = own[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            own, n_of = own[first], np.diff(first, append=len(own))
            slope = _sums(part.reshape(-1, FAN), of[order], first, n_of)
            used[own] += n_of
            squares = self.squares[own] + (slope * slope) @ _ONES / FAN
            self.squares[own] = squares
            slope *= (RATE / np.sqrt(squares + 1e-2)).astype(np.float32)[:, None]
            self.weights[own] -= slope


def _sums(rows: np.ndarray, of: np.ndarray, first: np.ndarray, n_of: np.ndarray, short: int = 32) -> np.ndarray:
    """Sums of ``rows[of]`` over runs that begin at ``first``: the second, third, ... members of all short runs are added
    at once, as most runs have few; long runs are reduced one by one."""
    out = rows.take(of[first], axis=0)
    at, nth = np.flatnonzero((n_of > 1) & (n_of <= short)), 1
    while len(at):
        out[at] += rows.take(of[first[at] + nth], axis=0)
        nth += 1
        at = at[n_of[at] > nth]
    if len(long := np.flatnonzero(n_of > short)):
        ends = np.cumsum(n_of[long])
        begin = ends - n_of[long]
        out[long] = np.add.reduceat(rows.take(of[np.repeat(first[long] - begin, n_of[long]) + np.arange(ends[-1])], axis=0), begin, axis=0)
    return out


def arrange(neighbours: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The numbers in an order in which those with like neighbours are close: halves by the first principal axis of
    their neighbours, eight times, then by frequency."""
    x = np.sqrt(neighbours.astype(np.float32))
    x /= np.maximum(np.sqrt(neighbours.sum(axis=1, dtype=np.float64)), 1)[:, None].astype(np.float32)
    groups = [np.argsort(-mass, kind="stable")]
    for _ in range(8):
        parted = []
        for g in groups:
            weight = np.sqrt(mass[g] + 1.0)[:, None]
            centred = x[g] - (x[g] * weight).sum(axis=0) / weight.sum()
            cov = (centred * weight).T @ centred
            axis = np.linalg.eigh(cov.astype(np.float64))[1][:, -1]
            axis *= np.sign(axis[np.argmax(np.abs(axis))]) or 1
            by = np.argsort(centred @ axis.astype(np.float32), kind="stable")
            parted += [g[np.sort(by[: len(g) // 2])], g[np.sort(by[len(g) // 2 :])]]  # by frequency within
        groups = parted
    return np.concatenate(groups)


def _summed(parts: DataFrame, n_parts: int, width: int, kind: str) -> dict[int, np.ndarray]:
    """Sums of matrices ``parts(block, part, data)`` by block: 64 parts at a time meet in a task and are added one by one,
    so no task holds or reads more than 64 blocks, whatever the number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for b, p, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "data")), strict=True):
                if key != (b, p):
                    if key is not None:
                        yield _block(*key, total)
                    key, total = (b, p), np.zeros((BLOCK, width), np.float32)
                total += np.frombuffer(data, kind).reshape(BLOCK, width)
        if key is not None:
            yield _block(*key, total)

    while True:
        n_parts = -(-n_parts // TOGETHER)
        grouped = parts.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int"))
        parts = grouped.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, "block int, part int, data binary")
        if n_parts <= 1:
            return {r.block: np.frombuffer(r.data, np.float32).reshape(BLOCK, width) for r in parts.collect()}
        parts, kind = cut(parts), "float32"


def _block(block: int, part: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "part", "data"])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def word_counts(texts: DataFrame, held: int = 200_000) -> DataFrame:
    """``word, n`` (UTF-8 bytes) of all tokens, the ends of texts among them.  Tasks count what they read, ``held`` words
    at a time, so a frequent word is a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                if text:
                    seen.update(text.translate(_LOWER).split())
                seen[END] += 1
            if len(seen) > held:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of frequent words, and the numbers of all words.  Of fixed size: at most ``COUNTED`` words."""

    def __init__(self, counts: DataFrame):
        bands = counts.groupBy(F.floor(F.log2("n") * 8).alias("band")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("band")).collect()
        self.tokens, self.distinct = sum(r.n for r in bands), sum(r.v for r in bands)
        self.least, held = 1 << 62, 0
        for r in bands:
            held += r.v
            if held > COUNTED:
                break
            self.least = r.least
        head = sorted(((r.word, r.n) for r in counts.where(F.col("n") >= self.least).collect()), key=lambda r: (-r[1], r[0]))
        ends = next((n for w, n in head if bytes(w) == END), None)
        if ends is None:
            ends = next((r.n for r in counts.where(F.col("word") == F.lit(bytearray(END))).collect()), 0)
        head = [(bytes(w), n) for w, n in head if bytes(w) != END]
        self.words = [w for w, _ in head]
        #: of the end and of each word: count and number
        self.counts = np.array([ends, *(n for _, n in head)], np.int64)
        self.numbers = np.array([0, *(FIRST_WORD + i if FIRST_WORD + i < SLOTS else 1 + bucket(w) for i, w in enumerate(self.words))], np.uint16)
        slotless = np.flatnonzero((self.numbers >= 1) & (self.numbers < FIRST_WORD))
        self.mass = np.zeros(SLOTS)
        self.mass[self.numbers] = self.counts + 1
        n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
        np.add.at(n, self.numbers[slotless] - 1, self.counts[slotless])
        np.add.at(v, self.numbers[slotless] - 1, 1)
        by = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(BUCKETS))
        for r in counts.where((F.col("n") < self.least) & (F.col("word") != F.lit(bytearray(END)))).groupBy(by.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            n[r.b] += r.n
            v[r.b] += r.v
        self.mass[1:FIRST_WORD] = n + v + 1

    def table(self) -> tuple:
        return self.words, self.counts, self.numbers


def _encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each row's numbers, and what counts say about it: tokens, known ones, and sums of log10(count + 1), of all counted
    words and of those without a slot; ``rare`` holds the words that have no count here."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary.table())
    schema = T.StructType([*[docs.schema[c] for c in ("rid", "doc_id", "held_out", "rest")], *[T.StructField(c, t) for c, t in (("numbers", T.BinaryType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("log_all", T.DoubleType()), ("log_slotless", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, numbers = table.value
        place = dict(zip(words, range(1, len(words) + 1), strict=True))
        place[END] = 0
        # one entry more, for words without a count
        known = np.concatenate((counts > 0, [False]))
        logs = np.concatenate((np.log10(counts + 1.0), [0.0]))
        slotless = np.concatenate((np.where((numbers >= 1) & (numbers < FIRST_WORD), logs[:-1], 0), [0.0]))
        numbers = np.concatenate((numbers, np.zeros(1, np.uint16)))
        none = len(numbers) - 1
        for batch in slices(batches):
            flat, ends = [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                if text:
                    flat += text.translate(_LOWER).split()
                flat.append(END)
                ends.append(len(flat))
            at = np.fromiter(map(place.get, flat, repeat(none)), np.int64, len(flat))
            ends = np.array(ends, np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            own = numbers[at]
            missing = np.flatnonzero(at == none)
            rare = [flat[i] for i in missing.tolist()]
            own[missing] = [1 + bucket(w) for w in rare]
            cuts = np.searchsorted(missing, np.concatenate((starts, ends[-1:])))
            columns = [
                pa.array([own[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(ends - starts), pa.array(np.add.reduceat(known[at].astype(np.int64), starts)),
                pa.array(np.add.reduceat(logs[at], starts)), pa.array(np.add.reduceat(slotless[at], starts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare, pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "doc_id", "held_out", "rest")], *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a batch, with two ends before the first, and where each row starts."""
    rows = [np.frombuffer(b, np.uint16) for b in batch.column("numbers").to_pylist()]
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([np.zeros(2, np.uint16), *rows]), np.cumsum(lengths) - lengths


def _neighbours(encoded: DataFrame, mass: np.ndarray) -> np.ndarray:
    """How often each number stands after and before each of the most frequent ones, over all training rows."""
    often = np.full(SLOTS, NEIGHBOURS, np.int64)
    often[np.argsort(-mass, kind="stable")[:NEIGHBOURS]] = np.arange(NEIGHBOURS)
    width = 2 * NEIGHBOURS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * width, np.int32)
        some = False
        for batch in batches:
            if batch.num_rows:
                w = _flat(batch)[0][1:].astype(np.int64)
                for this, that, shift in ((w[1:], often[w[:-1]], 0), (w[:-1], often[w[1:]], NEIGHBOURS)):
                    keep = that < NEIGHBOURS
                    np.add.at(total, this[keep] * width + that[keep] + shift, 1)
                some = True
        if some:
            for k, block in enumerate(total.astype(np.float32).reshape(-1, BLOCK, width)):
                yield _block(k, _task(), block)

    n = encoded.rdd.getNumPartitions()
    out = np.zeros((SLOTS, width), np.float32)
    for k, block in _summed(encoded.select("numbers").mapInArrow(run, "block int, part int, data binary"), n, width, "float32").items():
        out[k * BLOCK : (k + 1) * BLOCK] = block
    return out


def _trained(encoded: DataFrame, model: Model, tokens: int) -> None:
    """Each training row teaches all features, in one of the rounds; a round begins with what those before it learned."""
    spark = encoded.sparkSession
    width = FAN + 2
    n_parts = max(1, min(encoded.rdd.getNumPartitions(), -(-tokens // (ROUNDS * TASK_TOKENS))))
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start = sent.value
            own = object.__new__(Model)
            own.slot, own.prior, own.weights, own.squares = start.slot, start.prior, start.weights.copy(), start.squares.copy()
            used = np.zeros(ROWS, np.float32)
            for batch in batches:
                if batch.num_rows:
                    own.train(_flat(batch)[0], used)
            if used.any():
                # how much each weight moved, how often it was used, and what its squares gained
                moved = np.concatenate(((own.weights - start.weights) * used[:, None], used[:, None], (own.squares - start.squares)[:, None]), axis=1, dtype=np.float32)
                for b, block in enumerate(moved.reshape(-1, BLOCK, width)):
                    yield _block(b, _task(), block)

        rows = encoded.where(F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)) == k).select("numbers").coalesce(n_parts)
        for b, block in _summed(rows.mapInArrow(run, "block int, part int, data binary"), n_parts, width, "float32").items():
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            model.weights[at] += block[:, :FAN] / np.maximum(block[:, FAN : FAN + 1], 1)
            model.squares[at] += block[:, FAN + 1]
        sent.destroy()


def language_model(docs: DataFrame, held_out: F.Column | None = None) -> DataFrame:
    """The log10 probability of each whole text under the model, and under add-one unigrams.

    ``held_out`` (a Column, false by default): rows that nothing is learned from.  Tokens are words
    ``[^\\x20\\x09-\\x0D]+``, A to Z lower-cased, then one end.  Returns ``doc_id``, ``held_out``, ``n_tokens``,
    ``n_known`` (tokens that training rows have), ``train_tokens``, ``base_score``, ``score`` and ``rest`` (all other
    columns but the text).

    Rows are documents; repeated rows are learned from each time and get equal scores.  A null or empty text is its end
    alone.  Without training rows the model is uniform over what it can't tell apart; base scores are 0 then.  An empty
    table gives no rows.  Texts are read whole and in one pass; a worker holds about 2 MB of texts or one longer text.

    All training rows are counted and trained on.  The driver holds the model (262,144 rows of 16 weights), the counts
    of at most 262,144 words and sums of fixed size; other words meet their counts in a join."""
    spark = docs.sparkSession
    marked = docs.withColumn("_held", F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False))
    base = marked.select("doc_id", "text", F.col("_held").alias("held_out"), others(docs, "doc_id", "text").alias("rest"))
    counts = cut(word_counts(base.where("not held_out")))
    vocabulary = Vocabulary(counts)
    encoded = cut(_encoded(base.withColumn("rid", F.monotonically_increasing_id()), vocabulary))
    training = encoded.where("not held_out")
    model = Model(vocabulary.mass, arrange(_neighbours(training, vocabulary.mass), vocabulary.mass))
    _trained(training, model, vocabulary.tokens)
    sent = spark.sparkContext.broadcast((model, np.log10(vocabulary.mass[:FIRST_WORD])))
    kept = ["rid", "doc_id", "held_out", "rest", "n_tokens", "known", "log_all", "log_slotless"]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("slots", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shared = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                w, starts = _flat(batch)
                each, now = model.score(w), w[2:]
                inside = (now >= 1) & (now < FIRST_WORD)
                each[inside] -= shared[now[inside]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.add.reduceat(each, starts))], names=schema.names)

    scored = encoded.mapInArrow(run, schema)
    rare = encoded.select("rid", F.explode("rare").alias("word")).join(counts.where(F.col("n") < vocabulary.least), "word")
    joined = rare.groupBy(F.col("rid").alias("of")).agg(F.sum(F.log10(F.col("n") + 1)).alias("log_rare"), F.count("*").alias("known_rare"))
    both = scored.join(joined, scored.rid == joined["of"], "left")
    more, total = F.coalesce("log_rare", F.lit(0.0)), math.log10(vocabulary.tokens + vocabulary.distinct + 1)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") + more - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("slots") + F.col("log_slotless") + more).alias("score"), "rest",
    )


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return language_model(tables(spark, sf_dir, "documents").select("doc_id", "text"), held).drop("rest")
