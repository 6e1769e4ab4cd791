"""Toxic passages by maximum-scoring segments.

Each word has a log-odds score of standing in toxic text, with a Dirichlet prior (here of two
categories: beta) centred on the share of toxic texts.  Words that prove nothing by themselves are
pooled by prefix, the longest first, so an unseen form of a known stem has a score; what a word or
longer prefix explains doesn't count for a shorter one.  A linear scan finds every maximal scoring segment of a
text; the extreme-value law of clean texts turns segment scores into expected counts, and the
evidence of the significant ones is calibrated on the learning rows.
"""

from __future__ import annotations

import bisect
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import discard, held, letter_words, map_rows, materialize, table
from gapweave.llm.langid import fold

#: Prefix lengths, shortest first; the base rate stands above them.
PREFIXES = (3, 4, 5, 6)
#: Strength of the prior in texts, and least number of toxic texts with a unit.
ALPHA, LEAST = 4.0, 4
#: Units kept: those with this log-odds and this many standard deviations of it over the base.  A unit
#: counts once for each text, so one long text proves little.
LEAST_SCORE, LEAST_Z = 2.0, 4.5
#: What any other word costs; keeps the expected score of clean text negative.
DRIFT = 0.03
THRESHOLD = 0.7
#: Most labelled rows that are learned from, chosen by the hash of doc_id.  They are broadcast to the
#: texts, 16 bytes each, so texts are never shuffled.
LABELLED = 200_000
CACHE = 100_000

def learn_units(rows: DataFrame) -> dict[str, float]:
    """Log-odds of words and prefixes (ending in ``*``) of rows (text, toxic).

    Words are counted per task before they are shuffled; only units above LEAST_SCORE come to the driver.
    Each takes LEAST toxic texts of the LABELLED ones that are learned from, which bounds them."""
    w = (
        rows.where("text IS NOT NULL AND toxic IS NOT NULL")
        .select("toxic", F.explode(F.array_distinct(F.split(letter_words(F.col("text")), " "))).alias("w"))
        .where(r"w RLIKE '^\\p{L}+$'")
        .groupBy("w")
        .agg(F.sum(F.expr("IF(toxic = 1, 1L, 0L)")).alias("t"), F.sum(F.expr("IF(toxic = 1, 0L, 1L)")).alias("c"))
    )
    w = materialize(w, "toxic-words")
    all_t, all_c = w.agg(F.sum("t"), F.sum("c")).first()
    if not all_t or not all_c:
        discard(w)
        return {}
    base = all_t / (all_t + all_c)
    t, c = F.col("t"), F.col("c")
    share = (t + ALPHA * base) / (t + c + ALPHA)
    score = F.log(share / (1 - share)) - math.log(base / (1 - base))
    sigma = F.sqrt(1 / (t + ALPHA * base) + 1 / (c + ALPHA * (1 - base)))
    out: dict[str, float] = {}
    left = w
    for n in (None, *reversed(PREFIXES)):
        level = left.select(F.col("w").alias("u"), "t", "c", F.lit(1).alias("forms"))
        if n is not None:
            level = left.where(F.length("w") >= n).groupBy(F.substring("w", 1, n).alias("u")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("forms"))
            level = level.where("forms >= 3")
        good = level.where((t >= LEAST) & (score >= LEAST_SCORE) & (score >= LEAST_Z * sigma)).select("u", score.alias("s"))
        found = good.collect()
        if not found:
            continue
        out |= {r.u + ("" if n is None else "*"): float(r.s) for r in found}
        covered = F.broadcast(w.sparkSession.createDataFrame([(r.u,) for r in found], "g string"))
        left = left.join(covered, (F.col("w") if n is None else F.substring("w", 1, n)) == F.col("g"), "left_anti")
    discard(w)
    return out


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence in which position i of ``scores``
    has the given positive score and every other position costs ``drift``; linear in ``scores``."""
    segs: list[list] = []  # start, end, sum before, sum after, index of the last one with a smaller sum before
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        at = i + 1
        new = [i, i + 1, total, total + s, -1]
        total += s
        j = len(segs) - 1
        while True:
            while j >= 0 and segs[j][2] >= new[2]:
                j = segs[j][4]
            if j < 0 or segs[j][3] >= new[3]:
                new[4] = j
                segs.append(new)
                break
            new[0], new[2] = segs[j][0], segs[j][2]
            back = segs[j][4]
            del segs[j:]
            j = back
    return [(a, b, hi - lo) for a, b, lo, hi, _ in segs]


class Scorer:
    def __init__(self, units: dict[str, float]):
        self.units, self.cache = units, {}

    def word(self, w: str) -> float:
        """The score of a word, or 0 if it is not above the drift."""
        s = self.units.get(w)
        if s is None:
            s = next((x for n in reversed(PREFIXES) if len(w) >= n and (x := self.units.get(w[:n] + "*")) is not None), 0.0)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[w] = s
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float, int]]]:
        """(number of words, maximal segments over word positions with their number of scoring words) of a text
        that went through ``letter_words``."""
        words = [w for w in (text or "").split() if w[0].isalpha()]
        get, word = self.cache.get, self.word
        hits = [(i, s) for i, w in enumerate(words) if (s := (x if (x := get(w)) is not None else word(w)))]
        at = [i for i, _ in hits]
        return len(words), [(a, b, s, bisect.bisect_left(at, b) - bisect.bisect_left(at, a)) for a, b, s in maximal_segments(hits, DRIFT)]


def segment_scores(docs: DataFrame, units: dict[str, float]) -> DataFrame:
    """(doc_id, n, segs array<struct<a,b,s,h>>) of each row; no row moves."""
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(units)

    def rows(batch):
        scorer = held(key, lambda: Scorer(shipped.value))
        out = []
        for doc_id, text in batch:
            n, segs = scorer.segments(text)
            out.append((doc_id, n, [{"a": a, "b": b, "s": s, "h": h} for a, b, s, h in segs]))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", letter_words(F.col("text"))), rows, f"doc_id {kind}, n long, segs array<struct<a:int,b:int,s:double,h:int>>", key)


def solve_lambda(hist: list[tuple[float, float]]) -> float:
    """The positive root of sum p * exp(x * s) = 1 over (score, share) of clean words."""
    f = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in hist) - 1
    lo, hi = 1e-3, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(max(lo, 0.1), 5.0)


#: Evidence is calibrated in steps of 1 / STEPS up to MOST.
STEPS, MOST = 4, 20


def fit_steps(bins: list[tuple[int, float, float]]) -> list[float]:
    """The share of toxic texts for each step of evidence, rising: pooled adjacent violators over
    (step, toxic, clean) counts, with the overall share as one pseudo-text of each pool."""
    toxic, clean = sum(t for _, t, _ in bins), sum(c for _, _, c in bins)
    if not toxic or not clean:
        return [0.5] * (STEPS * MOST + 1)
    base = toxic / (toxic + clean)
    pools: list[list[float]] = []  # first step, toxic, all
    for k, t, c in sorted(bins):
        pools.append([k, t, t + c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    out, now, at = [], (pools[0][1] + base) / (pools[0][2] + 1), 0
    for k in range(STEPS * MOST + 1):
        while at < len(pools) and pools[at][0] <= k:
            now = max(now, (pools[at][1] + base) / (pools[at][2] + 1)) if at else now
            at += 1
        out.append(min(now, 0.999))
    return out


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, n_segments, worst array<struct<a,b,s>>): the significant segments, by word
    positions.  ``labels`` (doc_id, toxic) are learned from, up to LABELLED rows; hold rows out before.

    Repeated labels of a doc_id count once, as toxic if one of them is.  Without labels of both
    kinds every score is 0.5.  Null and empty texts get the score of no evidence.  Texts count whole; a row
    that repeats gives a row each with the same score, an empty table none; other columns are not read.  Evidence on the
    border of two steps counts for the higher one."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.98 * LABELLED / n))
    known = F.broadcast(known)
    d = docs.select("doc_id", "text")
    units = learn_units(d.join(known, "doc_id").select("text", "toxic"))
    found = materialize(segment_scores(d, units), "segments")
    best = F.coalesce(F.array_max(F.transform("segs", lambda x: x["s"])), F.lit(0.0))
    learned = found.join(known, "doc_id").select("n", "toxic", "segs", best.alias("best"))
    if units:
        clean = learned.where("toxic != 1 AND n > 0")
        # Shares of clean words by score, each scoring word of a segment at the segment's mean: some
        # labels are wrong, and single words tell less of that than whole segments would.
        words = clean.agg(F.sum("n")).first()[0]
        by = clean.select(F.explode("segs").alias("x")).groupBy(F.round(F.col("x.s") / F.col("x.h"), 1).alias("s")).agg(F.sum("x.h").alias("c")).collect()
        hist = [(float(r.s), r.c / words) for r in by] if words else []
        lam = solve_lambda([*hist, (-DRIFT, 1 - sum(p for _, p in hist)), (3.0, 1e-6)])
        k = clean.agg((F.count(F.lit(1)) / F.sum(F.col("n") * F.exp(-lam * F.col("best")))).alias("k")).first()["k"] or 0.1
        k = min(max(float(k), 1e-4), 1.0)
    else:
        lam, k = 1.0, 0.1
    floor = F.log(F.lit(k) * F.greatest("n", F.lit(1)))
    evidence = F.aggregate(F.transform("segs", lambda x: F.greatest(lam * x["s"] - floor, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    evidence = F.least(evidence, F.lit(float(MOST)))
    step = F.floor(evidence * STEPS).cast("int")
    bins = learned.select(step.alias("k"), "toxic").groupBy("k").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).collect()
    values = F.array(*[F.lit(float(v)) for v in fit_steps([(r.k, r.t, r.c) for r in bins])])
    score = F.element_at(values, step + 1) + evidence * 1e-5  # ranks texts within a step
    significant = F.filter("segs", lambda x: lam * x["s"] > floor)
    return found.select("doc_id", score.alias("score"), F.size(significant).cast("long").alias("n_segments"), significant.alias("worst"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learning = labels.select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    out = score_documents(docs, learning)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments")
