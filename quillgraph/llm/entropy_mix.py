"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, local_rows, others, tables

#: Under this many sources their solved parameters (five numbers each) are broadcast; above it, Spark joins them.
BROADCAST_SOURCES = 20_000
OFFSETS = 64
#: So many runs of each source, band and direction are offered to give or take one copy to settle the rest.
SPARE = 8


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Words wanted of each source.  Sources in code-point order, null last, take the weights in turn.  No target is
    above ``most`` times its source; the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left, mass = total - sum(full.values()), sum(weigh[s] for s in free)
        over = [s for s in free if left * weigh[s] / mass > most * sizes[s]]
        if not over:
            return full | {s: left * weigh[s] / mass for s in free}
        full |= {s: most * sizes[s] for s in over}


def settle(due: float, offers: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Which of the ``offers`` (size, part, +1 or -1 copy) to take so that ``due`` words are nearly met: the largest that
    fit, then the pair (or one) that leaves least."""
    taken: list[tuple[int, int, int]] = []
    used: set[tuple[int, int]] = set()
    for size, part, way in sorted(offers, key=lambda o: (-o[0], o[1:])):
        if size <= abs(due) and (due > 0) == (way > 0) and (size, part) not in used:
            used.add((size, part))
            due -= way * size
            taken.append((size, part, way))
    left = sorted((way * size, size, part, way) for size, part, way in offers if (size, part) not in used)
    best, pick, i, j = abs(due), [], 0, len(left) - 1
    for x in left:
        if abs(due - x[0]) < best:
            best, pick = abs(due - x[0]), [x]
    while i < j:
        both = left[i][0] + left[j][0]
        if left[i][1:3] != left[j][1:3] and abs(due - both) < best:
            best, pick = abs(due - both), [left[i], left[j]]
        i, j = (i + 1, j) if both < due else (i, j - 1)
    return taken + [x[1:] for x in pick]


class _Dual:
    """One source's dual variable.  Newton on log(words), kept inside a bracket: the words rise with ``lam``."""

    def __init__(self, target: float, size: float, least: float, most: float):
        self.target, self.most = target, most
        self.lam, self.low, self.high = 0.0, None, math.log(most) / least if least else 0.0
        self.done = target <= 0 or target >= most * size * (1 - 1e-12)
        self.fixed = (0.0 if target <= 0 else most) if self.done else None

    def step(self, words: float, slope: float, close: float) -> None:
        if self.done:
            return
        if abs(words - self.target) <= close * self.target:
            self.done = True
            return
        if words > self.target:
            self.high = self.lam
        else:
            self.low = self.lam
        new = self.lam - (math.log(words / self.target) * words / slope if words > 0 and slope > 0 else 0.0)
        low = self.low if self.low is not None else -math.inf
        if not low < new < self.high:
            new = (self.low + self.high) / 2 if self.low is not None else min(-1.0, 2 * self.lam)
        self.done, self.lam = new == self.lam, new


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, close: float = 1e-9, max_rounds: int = 200, per_bucket: int = 50_000) -> DataFrame:
    """Copies of each document such that every source yields its target of words.

    The rates minimise the relative entropy to "each document once" under one token constraint a source and the box
    0 <= rate <= ``most``.  The dual is convex; its solution tilts documents exponentially: rate = min(most,
    exp(lam_source * size / mean size)).  Newton iterations find ``lam``; each is one distributed aggregate over the
    histogram (source, size, documents), which holds all that the dual needs and has a row for each different size.
    Rates become whole copies by systematic rounding along each source's documents in size order, band by band (sizes
    of one power of two): the copies of a run of documents differ from its summed rates by under one.  Of 64 starting
    offsets the band takes the one whose words are nearest to its due, and what it lacks or has over is due from the
    next smaller band.  What is still owed at the end is settled by single documents that give or take one copy.  No
    random numbers: reruns agree.

    Returns ``doc_id, source, size, source_size, target, rate, copies, taken`` and ``rest`` (all other columns but the text).

    Rows are documents; repeated rows count each.  Null text: size 0, and so taken 0.  Null source: a source of its
    own, last in order.  Null doc_id: as any other id.  Empty table: no rows.  The driver holds a few numbers for
    each source, never one for each document.  Many documents of one source and size are dealt to buckets of about
    ``per_bucket`` rows, so neither a hot source nor a hot size meets in one task.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("text").alias("sign"), others(docs, "doc_id", "text").alias("rest"))
    # the sizes cost a scan of all text, so they are kept; a row has a few dozen bytes
    base = cut(base)
    hist = cut(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    stats = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.max("n").alias("crowd")).collect()
    want = targets({r.source: r.words for r in stats}, weights, share, float(most)) if stats else {}
    mean = {r.source: max(1.0, r.words / r.docs) for r in stats}
    duals = {r.source: _Dual(want[r.source], r.words, (r.least or 0) / mean[r.source], float(most)) for r in stats}
    small = len(stats) <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)

    def solved(**more) -> DataFrame:
        rows = [(s, float(mean[s]), float(d.lam), d.fixed, *(float(m[s]) for m in more.values())) for s, d in duals.items()]
        names = "".join(f", {k} double" for k in more)
        return hint(local_rows(spark, rows, f"src string, mean double, lam double, fixed double{names}"))

    def rated(df: DataFrame, **more) -> DataFrame:
        joined = df.join(solved(**more), F.col("source").eqNullSafe(F.col("src")))
        return joined.withColumn("rate", F.coalesce("fixed", F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))))

    for turn in range(max_rounds + 1):
        if all(d.done for d in duals.values()):
            break
        if turn == max_rounds:
            raise RuntimeError(f"the dual has not converged after {max_rounds} Newton rounds")
        mass = F.col("size") * F.col("n") * F.col("rate")
        sums = rated(hist).groupBy("source").agg(F.sum(mass).alias("words"), F.sum(F.when(F.col("rate") < most, mass * F.col("size") / F.col("mean"))).alias("slope"))
        for r in sums.collect():
            duals[r.source].step(r.words or 0.0, r.slope or 0.0, close)

    parts = max(1, math.ceil(max((r.crowd for r in stats), default=0) / per_bucket))
    base = base.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    runs = base.groupBy("source", "size", "part").agg(F.count("*").alias("n")) if parts > 1 else hist.withColumn("part", F.lit(0).cast("long"))
    # systematic rounding in each band of sizes (powers of two), from large to small
    band = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")
    along = Window.partitionBy("source", "band").orderBy(F.desc("size"), "part")
    runs = rated(runs.withColumn("band", band)).withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(runs.select("source", "band", "size", "part", "n", "rate", (F.col("upto") - F.col("n") * F.col("rate")).alias("before")))

    offsets = [(j + 0.5) / OFFSETS for j in range(OFFSETS)]
    gained = lambda u: F.sum(F.col("size") * (F.floor(F.col("before") + F.col("n") * F.col("rate") + u) - F.floor(F.col("before") + u)))
    tried = runs.groupBy("source", "band").agg(F.array(*[gained(u) for u in offsets]).alias("got"), F.sum(F.col("size") * F.col("n") * F.col("rate")).alias("mass")).collect()
    starts, owed = [], {}
    for r in sorted(tried, key=lambda r: -r.band):
        due = r.mass + owed.get(r.source, 0.0)
        u = min(offsets, key=lambda u, got=r.got, due=due: (abs(got[offsets.index(u)] - due), u))
        owed[r.source] = due - r.got[offsets.index(u)]
        starts.append((r.source, r.band, u))
    chosen = hint(local_rows(spark, starts, "src string, b2 int, start double"))
    runs = runs.join(chosen, F.col("source").eqNullSafe(F.col("src")) & (F.col("band") == F.col("b2"))).drop("src", "b2")

    # what is still owed goes to single documents: the first ones of the smallest runs of each band, largest that fit
    one = F.floor(F.col("before") + F.col("rate") + F.col("start")) - F.floor(F.col("before") + F.col("start"))
    few = Window.partitionBy("source", "band", "spare").orderBy("size", "part")
    spare = runs.where("size > 0").withColumn("one", one).withColumn("spare", F.explode(F.array_compact(F.array(F.when(F.col("one") > 0, -1), F.when(F.col("one") < most, 1)))))
    spare = spare.withColumn("k", F.row_number().over(few)).where(F.col("k") <= SPARE).select("source", "size", "part", "spare").collect()
    offers: dict = {}
    for r in spare:
        offers.setdefault(r.source, []).append((r.size, r.part, r.spare))
    fixes = [(s, *fix) for s, own in offers.items() for fix in settle(owed.get(s, 0.0), own)]
    fixed = hint(local_rows(spark, fixes, "src string, z3 long, p3 long, fix int"))
    runs = runs.join(fixed, F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("z3")) & (F.col("part") == F.col("p3")), "left")

    facts = {"source_size": {r.source: r.words for r in stats}, "target": want}
    ranked = base.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id", "sign")))
    runs = runs.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("part").alias("p2"), "before", "start", F.coalesce("fix", F.lit(0)).alias("fix"))
    placed = ranked.join(runs, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("part") == F.col("p2")))
    placed = rated(placed, **facts)
    at = lambda k: F.floor(F.col("before") + k * F.col("rate") + F.col("start"))
    copies = at(F.col("nth")) - at(F.col("nth") - 1) + F.when(F.col("nth") == 1, F.col("fix")).otherwise(0)
    copies = F.greatest(F.lit(0), F.least(F.lit(most), copies)).cast("long")
    out = placed.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rest")


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = entropy_mix(tables(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
