"""Spelling variants by a trie self-join with active-node sets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, tables

#: Words have so many code points and occurrences at least; a form has so many times its word's occurrences.
SHORTEST, OFTEN, TIMES = 7, 2, 10
#: A partition of the trie has at most so many words, or this share of all words if that is more: so there are never more
#: than four times its inverse of larger ones.
MOST_WORDS, MOST_SHARE = 4_096, 1 / 16_384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters of the contract; a shorter run can't become a word.
_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)
#: Counters of a task are passed on at so many words.
HELD = 200_000


def occurrences(docs: DataFrame, slips: bool = False) -> DataFrame:
    """``word, n`` of all runs of letters with at least ``SHORTEST`` code points.  ``slips`` first deletes one letter of
    every 31st run (by the contract's hash of document and run); rows without an id have no slips.

    A task counts what it reads and passes on a row for each ``HELD`` words at most, so a frequent word is a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if not text:
                    continue
                words = _RUNS.findall(text.translate(_LOWER).decode())
                if not slips or doc_id is None:
                    seen.update(words)
                    continue
                prefix = zlib.crc32(b"%d:" % doc_id)
                for word in words:
                    h = zlib.crc32(word.encode(), prefix)
                    if h % 31 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    seen[word] += 1
            if len(seen) > HELD:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


class Trie:
    """Words by their code points; a node is [children by letter, number of the word that ends here or -1]."""

    def __init__(self, words: list[str]):
        self.root: list = [{}, -1]
        for k, word in enumerate(words):
            node = self.root
            for c in word:
                below = node[0].get(c)
                if below is None:
                    below = node[0][c] = [{}, -1]
                node = below
            node[1] = k

    def join(self) -> Iterator[tuple[int, int]]:
        """Pairs of words (each once) at edit distance one.

        From the root down, each node gets its active nodes: those whose strings are one edit from its own.  A child
        takes over its parent's active nodes by one step with its letter, and gains the parent (its letter is deleted),
        its siblings (replaced) and its own children (inserted)."""
        root = self.root
        stack = [(root, list(root[0].values()))]
        while stack:
            node, active = stack.pop()
            for letter, child in node[0].items():
                near = {id(v): v for v in child[0].values()}
                near.update((id(v), v) for v in node[0].values())
                near[id(node)] = node
                for v in active:
                    step = v[0].get(letter)
                    if step is not None:
                        near[id(step)] = step
                near.pop(id(child), None)
                mine = child[1]
                if mine >= 0:
                    for v in near.values():
                        if v[1] > mine:
                            yield mine, v[1]
                if child[0]:
                    stack.append((child, list(near.values())))


def _halves(rows: DataFrame, path: Column, length: Column) -> DataFrame:
    """The rows of ``word, n, path, lo, cut, size, tests`` once more for each half of their open stretch.

    The stretch of a word is what lies between ``lo`` letters at its start and ``cut`` at its end, which all words of a
    partition share.  Two stretches of ``length`` letters, or one of them with one more, that are one edit apart share
    their first half or their last one, so the pair meets in one of the two partitions.  ``tests`` are the first halves
    (start, length) by which a partition of last halves knows pairs that the other one has."""
    half = F.floor(length / 2).cast("int")
    first = F.struct(
        F.concat(path, F.lit("<"), F.expr("substring(word, lo + 1, half)")).alias("path"), (F.col("lo") + F.col("half")).alias("lo"), F.col("cut").alias("cut"), (F.col("length") - F.col("half")).alias("size"), F.col("tests").alias("tests")
    )
    last = F.struct(
        F.concat(path, F.lit(">"), F.expr("substring(word, char_length(word) - cut - (length - half) + 1, length - half)")).alias("path"), F.col("lo").alias("lo"), (F.col("cut") + F.col("length") - F.col("half")).alias("cut"), F.col("half").alias("size"),
        F.concat(F.col("tests"), F.array(F.struct(F.col("lo").alias("at"), F.col("half").alias("n")))).alias("tests"),
    )
    split = rows.withColumn("length", length).withColumn("half", half)
    return split.select("word", "n", F.explode(F.array(first, last)).alias("s")).select("word", "n", "s.*")


def partitions(vocabulary: DataFrame) -> DataFrame:
    """The trie's partitions as ``path, word, n, lo, cut, tests``: words one edit apart meet in at least one.

    First each word goes to the partitions of its own length and of one less (for its shorter partners), by first half and
    by last half.  A partition with too many words is split in the same way by the halves of what is left, until one
    letter is; so none outgrows a task, whatever the words share, and no word's copies depend on how many are near."""
    most = max(MOST_WORDS, int(vocabulary.count() * MOST_SHARE))
    size = F.char_length("word")
    start = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where(F.col("size") >= SHORTEST)
    rows = _halves(start.withColumns({"lo": F.lit(0), "cut": F.lit(0), "tests": F.expr("cast(array() as array<struct<at: int, n: int>>)")}), F.col("size").cast("string"), F.col("size"))
    done = None
    while True:
        large = cut(rows.groupBy("path").agg(F.count("*").alias("words"), F.first("size").alias("left")).where((F.col("words") > most) & (F.col("left") > 1)).select("path"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # at most 4 / MOST_SHARE of these, by the choice of ``most``
        settled = rows.join(F.broadcast(large), "path", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        open_rows = rows.join(F.broadcast(large), "path", "left_semi").withColumn("above", F.col("path")).drop("path")
        rows = cut(_halves(open_rows, F.col("above"), F.col("size")))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` of all words one edit apart, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            words, counts, (lo, cut_, size, tests) = group
            if len(words) < 2:
                continue
            found, longer = [], lo + size + cut_ + 1
            for i, j in Trie([w[lo : len(w) - cut_] for w in words]).join():
                a, b = words[i], words[j]
                if len(a) == len(b) == longer:  # they meet where their length is at home
                    continue
                if not any(a[t["at"] : t["at"] + t["n"]] == b[t["at"] : t["at"] + t["n"]] for t in tests):
                    found += [(a, counts[i], b, counts[j]), (b, counts[j], a, counts[i])]
            if found:
                a, n, b, m = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.string()), pa.array(m, pa.int64())], names=["word", "n", "other", "other_n"])

    rows = partitions(vocabulary).select("path", "word", "n", "lo", "cut", "size", "tests")
    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, "word string, n long, other string, other_n long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int], tuple]]:
    """Words, counts and (lo, cut, size, tests) of each path; rows are in the order of paths."""
    path, words, counts, how = None, [], [], ()
    for batch in batches:
        paths, ws, ns, los, cuts, sizes = (batch.column(c).to_pylist() for c in ("path", "word", "n", "lo", "cut", "size"))
        tests = batch.column("tests")
        for k, p in enumerate(paths):
            if p != path:
                if path is not None:
                    yield words, counts, how
                path, words, counts, how = p, [], [], (los[k], cuts[k], sizes[k], tests[k].as_py())
            words.append(ws[k])
            counts.append(ns[k])
    if path is not None:
        yield words, counts, how


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed to their end, twice as far each round.  A form has ten times
    its word's occurrences, so no chain has over 20 words and there are at most five rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spellings(docs: DataFrame, slips: bool = False) -> DataFrame:
    """Words of whole texts, with the frequent word that each may be a slip of.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` (A to Z lower-cased) of at least 7 code points that occur at least
    twice.  Returns ``word``; ``form``: its near word (one code point inserted, deleted or replaced) of largest ``n``
    (ties: smallest in code-point order) if that is at least ten times the word's, else null; ``root``: where forms lead
    from it in the end, itself without one; ``n``; ``n_near``: its near words, and ``form_n``.

    Null and empty texts have no words; repeated rows count each time; other columns don't matter.  An empty table gives
    no rows.  Texts are read whole; a worker holds one text's words.  Nothing passes through the driver but counts; at
    most 65,536 names of too large partitions are broadcast."""
    counted = cut(occurrences(docs, slips).where(F.col("n") >= OFTEN))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(counted).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = counted.join(near, "word", "left").withColumn("has", -F.col("best.minus") >= TIMES * F.col("n"))
    formed = cut(formed.select("word", F.when(F.col("has"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), -F.col("best.minus")).alias("form_n")))
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(tables(spark, sf_dir, "documents").select("doc_id", "text"), slips=True)
