"""Language model, periodic runs and spelling variants against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import maxent_lm, registry, runs, spellings
from tests.conftest import DATA
from tests.llm.test_operators import ODD, odd, texts

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# 11


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [b"\n"]


def test_lm_counts_and_base_scores(spark, duck):
    """The whole query: counts and unigram scores by brute force; the model is better on texts that it hasn't seen."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts(duck)}
    seen = {d: tokens(t) for d, t in texts(duck).items()}
    c = Counter(w for d, ws in seen.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = registry.QUERIES["op11_maxent_lm"](spark, DATA).collect()
    assert len(rows) == len(seen)
    gain = 0
    for r in rows:
        ws = seen[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws))
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def small_model():
    rng = np.random.default_rng(1)
    mass = np.zeros(maxent_lm.SLOTS)
    mass[:300] = rng.integers(1, 1000, 300)
    return maxent_lm.Model(mass, rng.permutation(maxent_lm.SLOTS))


def test_lm_is_a_distribution_and_its_steps_lower_the_loss():
    """After any history the probabilities of all numbers sum to one; training on a text makes it likelier."""
    m, rng = small_model(), np.random.default_rng(2)
    text = np.concatenate(([0, 0], np.tile(rng.integers(1, 300, 50), 200))).astype(np.uint16)
    before = m.score(text).sum()
    used = np.zeros(maxent_lm.ROWS, np.float32)
    for k in range(len(maxent_lm.FEATURES)):
        m.train(text, used, k)
    assert used.sum() == 10_000 * sum(map(len, maxent_lm.FEATURES)) and m.score(text).sum() > before / 2
    for two, one in ((text[4], text[5]), (7, 299)):
        every = np.stack([np.full(maxent_lm.SLOTS, two), np.full(maxent_lm.SLOTS, one), np.arange(maxent_lm.SLOTS)], axis=1).astype(np.uint16).ravel()
        assert (10.0 ** m.score(every)[::3]).sum() == pytest.approx(1, abs=1e-3)


def test_lm_gradient_by_hand():
    """One step's direction is the choices' shares less the choices themselves, summed over a feature's words."""
    m = small_model()
    text = np.array([0, 0, 5, 9, 5, 9, 5, 8], np.uint16)
    nodes, rows, choices = m._rows(text, 0, 6)
    want = defaultdict(lambda: np.zeros(maxent_lm.FAN))
    for k in range(maxent_lm.LEVELS):
        for i in range(6):
            p = np.exp(m.prior[nodes[k][i]].astype(float))
            want[rows[0][k][i]] += p / p.sum() - np.eye(maxent_lm.FAN)[choices[k][i]]
    m.train(text, np.zeros(maxent_lm.ROWS, np.float32), 0)
    for r, slope in want.items():
        moved = -slope * maxent_lm.RATE / np.sqrt((slope**2).sum() / maxent_lm.FAN + 1e-2)
        assert m.weights[r] == pytest.approx(moved, abs=1e-4)


def test_lm_without_counts_of_all_words(spark, monkeypatch):
    """Words whose counts aren't broadcast meet them in the join, with the same result."""
    some = spark.createDataFrame([(i, f"common words here rare{i} Rare{i % 7} {'x' * (i % 3)}") for i in range(60)], "doc_id long, text string")
    held = maxent_lm.F.col("doc_id") % 5 == 0
    get = lambda: {r.doc_id: (r.n_known, r.base_score, r.n_tokens) for r in maxent_lm.language_model(some, held).collect()}
    whole = get()
    monkeypatch.setattr(maxent_lm, "COUNTED", 12)
    few = get()
    assert {d: (k, n) for d, (k, _, n) in few.items()} == {d: (k, n) for d, (k, _, n) in whole.items()}
    assert all(few[d][1] == pytest.approx(whole[d][1]) for d in whole)


def test_lm_on_odd_and_empty_tables(spark):
    got = maxent_lm.language_model(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.rest.rest == "r" and r.rest["size"] == "z" and math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert len({r.score for r in got if r.doc_id in (7, 8, 10)}) == 1
    assert maxent_lm.language_model(odd(spark, [])).count() == 0
    nothing = maxent_lm.language_model(odd(spark), maxent_lm.F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)


# 12


def runs_by_hand(words):
    """Every stretch of equal words p apart, for every p; of equal stretches the smallest p."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(12, 2 * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e, p) for (s, e), p in out.items())


def digest_by_hand(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(words)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    top = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    return (len(found), *longest, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, duck):
    short = {d: t for d, t in texts(duck).items() if len(t) < 12_000}
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    assert len(got) == len(texts(duck)) and len(short) > 180
    assert all(got[d] == digest_by_hand(t, d) for d, t in short.items())


def test_runs_of_random_words():
    """Few letters, planted periods, copied parts: several documents at a time against brute force."""
    rng, total = random.Random(4), 0
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            few = rng.choice([1, 2, 2, 3, 40])
            w = [rng.randrange(few) for _ in range(rng.randint(0, 90))]
            if len(w) > 4 and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // (3 + rng.randrange(8))
                w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
            if rng.random() < 0.5:
                k = rng.randint(1, 40)
                w = w + w[:k] + [99] + w[:k] + w[-k:]
            docs.append(w)
        lengths = np.array([len(w) for w in docs])
        ends = np.cumsum(lengths)
        flat = np.array([x + 1_000 * k for k, w in enumerate(docs) for x in w], np.int64)
        got = runs.all_runs(flat, ends - lengths, ends)
        for k, w in enumerate(docs):
            assert sorted(got.get(k, [])) == runs_by_hand(w)
            total += len(runs_by_hand(w))
    assert total > 1_000


def test_longest_previous_factors():
    words = [0, 1, 0, 1, 0, 2, 0, 1, 0, 1, 0, 2, 1]
    r = runs.Ranks(np.array(words), np.full(len(words), len(words)))
    r.finish()
    best, source = runs.longest_previous(r)
    lcp = lambda i, j: next((k for k in range(len(words) - j) if words[i + k] != words[j + k]), len(words) - j)
    assert best.tolist() == [max((lcp(i, j) for i in range(j)), default=0) for j in range(len(words))]
    assert all(lcp(int(source[j]), j) == best[j] for j in range(len(words)) if best[j])


def test_runs_of_long_texts_and_odd_rows(spark):
    (n, start, length, period, milli, *_), = runs.digests([b"a b c " * 100_000 + b"end"])
    assert (n, start, length, period, milli) == (1, 0, 300_000, 3, 100_000_000)
    got = runs.runs(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.rest.rest == "r" for r in got)
    by = {r.doc_id: r for r in got}
    assert (by[6].n_runs, by[6].period, by[6].length) == (1, 3, 9_000) and by[6].collapsed_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert by[1].n_runs == 0 and by[1].start is None and by[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.runs(odd(spark), repeats=True).count() == len(ODD) and runs.runs(odd(spark, [])).count() == 0


# 13


def spellings_by_hand(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: set() for w in n}
    by_hole = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for (_, _), group in by_hole.items():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spellings_query(spark, duck):
    want = spellings_by_hand(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert len(want) > 1_000 and any(x[0] for x in want.values())
    assert found(registry.QUERIES["op13_spelling_variants"](spark, DATA)) == want


def test_spellings_in_partitions_that_are_split(spark, monkeypatch):
    """Words that share most of their letters, chains of forms, ties; with partitions of three words."""
    rng = random.Random(7)
    words = Counter({"aaaaaaaaa": 5000, "aaaaaaaab": 400, "aaaaaaabb": 30, "aaaaaabbb": 2})
    for _ in range(250):
        words["prefixed" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))] += rng.choice([2, 2, 30, 400])
        words["".join(rng.choice("aé") for _ in range(rng.randint(7, 9)))] += rng.choice([2, 25, 300])
    docs = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], "doc_id long, text string").repartition(3)
    want = spellings_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(spellings, "MOST_WORDS", 3)
    monkeypatch.setattr(spellings, "MOST_SHARE", 0.0)
    assert found(spellings.spellings(docs, slips=True)) == want


def test_trie_pairs():
    rng = random.Random(8)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(20)})
        one = lambda a, b: any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        got = list(spellings.Trie(words).join())
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if one(words[i], words[j])}


def test_spellings_of_odd_and_empty_tables(spark):
    got = found(spellings.spellings(odd(spark, [*ODD, (11, "Tailored tailored TAILORED ÄPFELCHEN Äpfelchen"), (None, "tailore tailore tailore")]), slips=True))
    assert {"tailored", "tailore", "Äpfelchen"} >= set(got) and got["tailored"][2] >= 2
    assert spellings.spellings(odd(spark, [])).count() == 0


def test_lm_every_training_text_teaches_every_feature(spark, monkeypatch):
    """Over all rounds each token takes part once for each level of each feature: no feature learns from a share of texts."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 300, 40).astype(np.uint16).tobytes()) for i in range(60)]
    used, summed = [], maxent_lm._summed

    def spied(*given):
        out = summed(*given)
        used.append(sum(float(block[:, maxent_lm.FAN].sum()) for block in out.values()))
        return out

    monkeypatch.setattr(maxent_lm, "_summed", spied)
    maxent_lm._trained(spark.createDataFrame(rows, "rid long, numbers binary"), small_model(), 60 * 40)
    assert sum(used) == 60 * 40 * sum(map(len, maxent_lm.FEATURES))


def test_lm_sums_of_runs():
    rng = np.random.default_rng(4)
    n_of = np.array([1, 2, 40, 3, 33, 1, 32])
    first, rows, of = np.cumsum(n_of) - n_of, rng.random((50, 16)).astype(np.float32), rng.integers(0, 50, n_of.sum())
    assert np.allclose(maxent_lm._sums(rows, of, first, n_of), np.add.reduceat(rows[of], first, axis=0), atol=1e-4)
