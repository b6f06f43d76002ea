"""Toxicity: noisy-channel deobfuscation by Viterbi over character lattices, then a score of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, others, slices, tables

#: Letters that the language model tells apart: a-z and U+00DF to U+00FF.  0 is a boundary (all that is no letter),
#: the last number is any other letter.
_LETTERS = [chr(c) for c in [*range(97, 123), *range(0xDF, 0x100)] if chr(c).isalpha()]
K = len(_LETTERS) + 2
_NUMBER = {c: i + 1 for i, c in enumerate(_LETTERS)}
#: Up to the last letter that Unicode has assigned; what lies beyond is no letter.
_TABLE = np.array([_NUMBER.get(chr(c), K - 1 if chr(c).isalpha() else 0) for c in range(0x323B0)], dtype=np.int32)

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou"}
#: Costs (negative logs) of the channel: write a sign for a letter, keep or drop a repeated letter, drop a separator
#: between single letters or keep it as the end of a word.
SIGN_COST, KEEP_COST, DROP_COST, JOIN_COST, SPLIT_COST = 0.7, 1.2, 0.3, 0.1, 2.0
#: Costs of a sign around a word that stands for itself: punctuation is free, others rarely touch a word.
_MARK_COST = {c: 0.0 if c in "!|+(*" else SPLIT_COST for c in SIGNS}

#: A word with a sign anywhere; its cores, without other marks.
_SIGNED = re.compile(r"(?<!\S)[^\s0-9@$!|+€£(*]*[0-9@$!|+€£(*]\S*")
_CORE = re.compile(r"(?:[^\W_]|[@$!|+€£(*])+")
_REPEATED = re.compile(r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_SPACED = re.compile(r"(?<!\w)(?:[\w@$!][ .\-_*]{1,2}){3,}[\w@$!](?!\w)")
_WORD = re.compile(r"[^\W\d_]+")


def _class(c: str) -> int:
    """Bits: 1 may be a letter of a spaced word, 2 may stand between such letters, 4 is a letter, 8 is a word character."""
    word = c.isalnum() or c == "_"
    return (word or c in "@$!") | (c in " .-_*") << 1 | (c.isalnum() and not c.isdecimal()) << 2 | word << 3


_CLASS = np.array([_class(chr(c)) for c in range(len(_TABLE))], dtype=np.uint8)


def suspects(texts: list[str]) -> tuple[set[int], set[int]]:
    """Which of the texts may hold spaced words, and which letters repeated three times: all that the patterns find,
    told for many texts at once."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = np.concatenate((np.zeros(1, np.uint8), _CLASS[np.minimum(points, len(_CLASS) - 1)], np.zeros(8, np.uint8)))
    n = len(points)
    tripled = (points[:-2] == points[1:-1]) & (points[1:-1] == points[2:]) & (kind[1 : n - 1] & 4 > 0) if n > 2 else np.zeros(0, bool)
    some, between = kind & 1 > 0, kind & 2 > 0
    single = some[1:-1] & between[2:] & between[:-2]  # place i is character i
    first = some[1:-1] & between[2:] & (kind[:-2] & 8 == 0)
    pair = single[:-3] & (single[2:-1] | single[3:])
    spaced = first[:-6] & (pair[2:-1] | pair[3:])
    of = lambda at: set(np.searchsorted(ends, np.flatnonzero(at), "right").tolist())
    return of(spaced), of(tripled)


#: Decoded words that a worker keeps; at so many it starts anew.
SEEN = 32_768


class CharModel:
    """Interpolated character trigrams: ``cost[a, b, c]`` is -log P(c | a, b)."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(K, K, K).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + K)
        p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(p3).astype(np.float32)
        self.seen: dict[tuple[str, bool, bool], str] = {}
        self.tokens: dict[str, str] = {}

    def decode(self, written: str, spaced: bool = False, marked: bool = False) -> str:
        """The likeliest word (or words) behind what is written: Viterbi over the lattice of its characters, with the
        last two letters as the state.  If it may be ``marked``, signs around it are letters or stay as they are."""
        if (known := self.seen.get((written, spaced, marked))) is not None:
            return known
        first = last = 0
        if marked:
            first, last = (next((i for i, c in enumerate(x) if c not in SIGNS), len(x)) for x in (written, written[::-1]))
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        ended: tuple[float, tuple] = (math.inf, ())  # the word is over and marks follow
        for i, c in enumerate(written):
            letters = [(x, SIGN_COST) for x in SIGNS[c]] if c in SIGNS else [(c, 0.0)]
            drop = keep = None
            if spaced and c in " .-_*":
                letters, drop = [(" ", SPLIT_COST)], JOIN_COST
            elif i and c.isalpha() and written[i - 1] == c and (written[i - 2 : i + 1] == c * 3 or written[i - 1 : i + 2] == c * 3):
                drop, keep = DROP_COST, KEEP_COST
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            if i < first and (0, 0) in states:  # no letter came yet
                cost, out = states[0, 0]
                new[0, 0] = cost + _MARK_COST[c], (out, c)
            if i >= len(written) - last:
                ended = min(ended, *((cost + float(self.cost[a, b, 0]), out) for (a, b), (cost, out) in states.items()), key=lambda x: x[0])
                ended = ended[0] + _MARK_COST[c], (ended[1], c)
            for (a, b), (cost, out) in states.items():
                for x, more in letters:
                    n = _NUMBER.get(x, K - 1 if x.isalpha() else 0)
                    total = cost + more + (keep or 0.0) + float(self.cost[a, b, n])
                    if total < new.get((b, n), (math.inf,))[0]:
                        new[b, n] = total, (out, x)
                if drop is not None and cost + drop < new.get((a, b), (math.inf,))[0]:
                    new[a, b] = cost + drop, out
            states = new
        out = min(ended, *((cost + float(self.cost[a, b, 0]), out) for (a, b), (cost, out) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while out:
            out, x = out
            letters.append(x)
        best = "".join(reversed(letters))
        if len(self.seen) >= SEEN:
            self.seen.clear()
        if len(written) <= 64:
            self.seen[written, spaced, marked] = best
        return best

    def restore(self, text: str) -> str:
        return self.restore_all([text])[0]

    def restore_all(self, texts: list[str | None]) -> list[str]:
        """The texts in lower case with obfuscated words decoded.  A word is decoded if it mixes letters with signs,
        repeats a letter three times or more, or is a run of four or more single characters."""
        lower = [(t or "").lower() for t in texts]
        spaced, _ = suspects(lower)
        for k in spaced:
            lower[k] = _SPACED.sub(lambda m: self.decode(m[0], True) if sum(map(str.isalpha, m[0])) > 1 else m[0], lower[k])
        lower = [_SIGNED.sub(self._signed, t) for t in lower]
        for k in suspects(lower)[1]:
            lower[k] = _REPEATED.sub(lambda m: self.decode(m[0]), lower[k])
        return lower

    def _signed(self, m: re.Match) -> str:
        token = m[0]
        if (known := self.tokens.get(token)) is None:
            known = _CORE.sub(self._core, token)
            if len(self.tokens) >= SEEN:
                self.tokens.clear()
            if len(token) <= 64:
                self.tokens[token] = known
        return known

    def _core(self, m: re.Match) -> str:
        core = m[0]
        alphabetic = sum(map(str.isalpha, core))
        return core if alphabetic < 2 or alphabetic == len(core) else self.decode(core, marked=True)


def char_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts.  Tasks count into an array of fixed size; what meets is at most K cubed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, np.int64)
        for batch in slices(batches, limit=1 << 20):
            joined = "\n".join(t for t in batch.column(0).to_pylist() if t).lower()
            for i in range(0, len(joined), 1 << 20):  # a text of many MB in parts that overlap by two letters
                points = np.frombuffer(joined[max(0, i - 2) : i + (1 << 20)].encode("utf-32-le"), np.uint32)
                n = _TABLE[np.minimum(points, len(_TABLE) - 1)]
                total += np.bincount((n[:-2] * K + n[1:-1]) * K + n[2:], minlength=K**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(K**3, np.int64)
    for r in rows:
        counts[r.code] = r.n
    return counts


def features(restored: str) -> tuple[Counter, int]:
    """Words and their first 3 to 7 letters (``*``), and the number of words."""
    found = _WORD.findall(restored)
    return Counter(found), len(found)


def _parts(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(3, min(8, len(word))))]


class Scorer:
    """A logistic model over six figures of the marked words and stems that a text holds."""

    def __init__(self, marks: dict[str, float], weights: list[float] | None = None, mean=None, scale=None):
        self.marks, self.weights, self.mean, self.scale = marks, weights, mean, scale
        self.starts = {m[:3] for m in marks}
        self.short = {m for m in marks if len(m) < 3}

    def figures(self, restored: str) -> list[float]:
        words, n = features(restored)
        hits: Counter = Counter()
        for word, times in words.items():
            if word[:3] in self.starts or word in self.short:
                for part in _parts(word):
                    if part in self.marks:
                        hits[part] += times
        odds = [self.marks[p] for p in sorted(hits)]
        total = sum(self.marks[p] * hits[p] for p in sorted(hits))
        return [1.0, max(odds, default=0.0), math.log1p(sum(odds)), math.log1p(total), 10 * total / max(20, n), math.log1p(n) if odds else 0.0, float(bool(odds))]

    def fit(self, rows: list[list[float]], labels: list[int], ridge: float = 0.1) -> None:
        x, y = np.array(rows), np.array(labels, dtype=float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        mean[0], scale[0] = 0.0, 1.0
        x, w = (x - mean) / scale, np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.weights, self.mean, self.scale = w.tolist(), mean.tolist(), scale.tolist()

    def score(self, restored: str) -> float:
        if self.weights is None:
            return 0.0
        z = sum(w * (v - m) / s for w, v, m, s in zip(self.weights, self.figures(restored), self.mean, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _restored(labelled: DataFrame, model) -> DataFrame:
    """``labelled(text, toxic)`` with the texts restored, each row with its words and stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(model.value.restore_all(batch.column("text").to_pylist()), pa.string()), batch.column("toxic").cast(pa.int32())], names=["text", "toxic"])

    return labelled.mapInArrow(run, "text string, toxic int")


def _mark_counts(labelled: DataFrame) -> DataFrame:
    """How many toxic and other (restored) texts hold each word and stem, counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 24):
            ones, zeros = Counter(), Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                (ones if toxic else zeros).update({p for w in features(text.as_py())[0] for p in _parts(w)})
            names = list(ones | zeros)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ones[x] for x in names], pa.int64()), pa.array([zeros[x] for x in names], pa.int64())], names=["mark", "ones", "zeros"])

    return labelled.mapInArrow(run, "mark string, ones long, zeros long").groupBy("mark").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least: float = 20.0) -> tuple:
    """The language model, from all texts, and the scorer, from the documents of at most ``max_rows`` labelled ids that
    aren't held out (those that hash lowest).  Marks are the words and stems whose presence differs between the classes
    with a G2 statistic over ``least``; each needs several labelled texts that hold it, so the sample bounds them.
    Rows without a usable label are left out; with one class only, all scores are 0.

    The corpus is read twice here: for the trigrams, and for the labelled texts, which are restored once and written
    to the shared folder."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(CharModel(char_counts(docs)))
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), "toxic")
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("text", "toxic")
    labelled = cut(_restored(labelled, model))
    totals = labelled.groupBy("toxic").count().collect()
    n1, n0 = (sum(r["count"] for r in totals if r.toxic == k) for k in (1, 0))
    scorer = Scorer({})
    if not n1 or not n0:
        return model, scorer
    n = float(n1 + n0)
    a, b = F.col("ones").cast("double"), F.col("zeros").cast("double")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    held = a + b
    g2 = 2 * (part(a, held * (n1 / n)) + part(b, held * (n0 / n)) + part(n1 - a, (n - held) * (n1 / n)) + part(n0 - b, (n - held) * (n0 / n)))
    marks = _mark_counts(labelled).withColumn("g2", g2).where((F.col("g2") > least) & (a / n1 > b / n0)).collect()
    scorer = Scorer({r.mark: math.log((r.ones + 0.5) / (n1 + 1) * (n0 + 1) / (r.zeros + 0.5)) for r in sorted(marks, key=lambda r: r.mark)})
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [shared.value.figures(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])

    rows = labelled.mapInArrow(run, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r.y, r.x))  # at most max_rows rows; their order must not tell in sums of floats
    scorer.fit([r.x for r in rows], [r.y for r in rows])
    return model, scorer


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, restored: bool = False, keep_text: bool = True, **training) -> DataFrame:
    """Score each whole text after undoing leetspeak, spacing and repetition.

    Returns ``doc_id, held_out, score, predicted``, ``restored`` (the decoded text, lower-cased, if asked for), ``text``
    (as it came; null unless ``keep_text``) and ``rest``, all other input columns.  The only input of a score is the text.

    Rows are documents; repeated rows get equal scores.  A null text is empty; empty texts get a score too.  A null
    doc_id is not held out.  An empty table gives no rows; no labels, or labels of one class, give score 0.

    The language model (a fixed-size array) and the marks are broadcast; documents aren't shuffled, and texts pass
    through each worker once, in slices of about 1 MB.  Of a longer text a worker holds that one text and what it makes
    of it (about 100 bytes a word).
    """
    spark = docs.sparkSession
    model, scorer = train(docs, labels, **training)
    shared = spark.sparkContext.broadcast(scorer)
    base = docs.select("doc_id", "text", others(docs, "doc_id", "text").alias("rest"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("restored", T.StringType()), base.schema["text"], base.schema["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            plain = model.value.restore_all(batch.column("text").to_pylist())
            scores = list(map(shared.value.score, plain))
            texts = plain if restored else [None] * len(plain)
            kept = batch.column("text") if keep_text else pa.nulls(batch.num_rows, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(texts, pa.string()), kept, batch.column("rest")], names=schema.names)

    out = base.mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "restored", "text", "rest")


def op10_toxicity_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(tables(spark, sf_dir, "documents").select("doc_id", "text"), tables(spark, sf_dir, "labels"), keep_text=False)
    return scored.select("doc_id", "held_out", "score", "predicted")
