"""The learned operators against plain Python on whole small tables, and edge cases of operators and pipeline stages."""

import collections
import decimal
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import ann, chat, langid, secrets, toxicity
from gapweave.llm.common import table
from tests.oracle import DATA

SMALL = "/root/testdata/sf0.01"


def plain_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


# Toxicity


def plain_segments(hits, drift):
    """Maximal segments by their definition, over (position, score) of the scoring words alone: a segment begins and ends with one."""
    out, todo = [], [(0, len(hits))]
    while todo:
        lo, hi = todo.pop()
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += hits[j][1] - (drift * (hits[j][0] - hits[j - 1][0] - 1) if j > i else 0)
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            out.append((hits[best[1]][0], hits[best[2] - 1][0] + 1, best[0], best[2] - best[1]))
            todo += [(lo, best[1]), (best[2], hi)]
    return sorted(out)


def plain_units(texts):
    """{word, or prefix with a star: log-odds} of (words, toxic)."""
    count = collections.defaultdict(lambda: [0, 0])
    for words, toxic in texts:
        for w in set(words):
            count[w][0 if toxic else 1] += 1
    t_all, c_all = (sum(x[i] for x in count.values()) for i in (0, 1))
    base = t_all / (t_all + c_all)
    out, left = {}, dict(count)
    for n in (None, 6, 5, 4, 3):
        level = collections.defaultdict(lambda: [0, 0, 0])
        for w, (t, c) in left.items():
            if n is None or len(w) >= n:
                for i, v in enumerate((t, c, 1)):
                    level[w if n is None else w[:n]][i] += v
        found = set()
        for u, (t, c, forms) in level.items():
            share = (t + 4.0 * base) / (t + c + 4.0)
            score = math.log(share / (1 - share)) - math.log(base / (1 - base))
            sigma = math.sqrt(1 / (t + 4.0 * base) + 1 / (c + 4.0 * (1 - base)))
            if t >= 4 and score >= 2.0 and score >= 4.5 * sigma and (n is None or forms >= 3):
                found.add(u)
                out[u + ("" if n is None else "*")] = score
        left = {w: x for w, x in left.items() if (w if n is None else w[:n]) not in found}
    return out


def plain_toxicity(docs, labels):
    """{doc_id: (score, number of significant segments)} of {doc_id: text} and {doc_id: toxic}."""
    words = {i: plain_words(t) for i, t in docs.items()}
    units = plain_units([(words[i], labels[i] == 1) for i in docs if i in labels])
    unit = lambda w: units.get(w) or next((units[w[:n] + "*"] for n in (6, 5, 4, 3) if len(w) >= n and w[:n] + "*" in units), 0.0)
    segs = {i: plain_segments([(k, s) for k, w in enumerate(ws) if (s := unit(w))], 0.03) for i, ws in words.items()}
    clean = [i for i in docs if i in labels and labels[i] != 1 and words[i]]
    total, hist = sum(len(words[i]) for i in clean), collections.Counter()
    for i in clean:
        for _, _, s, h in segs[i]:
            hist[float(decimal.Decimal(repr(s / h)).quantize(decimal.Decimal("0.1"), decimal.ROUND_HALF_UP))] += h
    law = [(s, c / total) for s, c in hist.items()]
    law += [(-0.03, 1 - sum(p for _, p in law)), (3.0, 1e-6)]
    lo, hi = 1e-3, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(p * math.exp(min(mid * s, 700)) for s, p in law) < 1 else (lo, mid)
    lam = min(max(lo, 0.1), 5.0)
    best = {i: max((s for _, _, s, _ in segs[i]), default=0.0) for i in docs}
    k = min(max(len(clean) / sum(len(words[i]) * math.exp(-lam * best[i]) for i in clean), 1e-4), 1.0)
    floor = {i: math.log(k * max(len(words[i]), 1)) for i in docs}
    evidence = {i: min(20.0, sum(max(lam * s - floor[i], 0.0) for _, _, s, _ in segs[i])) for i in docs}
    toxic, every = collections.Counter(), collections.Counter()
    for i in docs:
        if i in labels:
            every[math.floor(evidence[i] * 4)] += 1
            toxic[math.floor(evidence[i] * 4)] += labels[i] == 1
    base = sum(toxic.values()) / sum(every.values())
    steps = sorted(every)
    # Isotonic means by the max-min formula; steps of one mean are a pool.
    mean = lambda a, b: sum(toxic[s] for s in steps[a : b + 1]) / sum(every[s] for s in steps[a : b + 1])
    fit = [round(max(min(mean(a, b) for b in range(i, len(steps))) for a in range(i + 1)), 12) for i in range(len(steps))]
    pools = {f: (sum(toxic[s] + 0 for s, g in zip(steps, fit, strict=True) if g == f) + base) / (sum(every[s] for s, g in zip(steps, fit, strict=True) if g == f) + 1) for f in fit}
    value = lambda step: min(0.999, max(pools[f] for s, f in zip(steps, fit, strict=True) if s <= step or f == fit[0]))
    return {i: (value(math.floor(evidence[i] * 4)) + evidence[i] * 1e-5, sum(lam * s > floor[i] for _, _, s, _ in segs[i])) for i in docs}


def test_toxicity_against_plain_python(spark):
    """All rows of the query: units, segments, law, calibration."""
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").where("toxic IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    want = plain_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert {i: r.n_segments for i, r in got.items()} == {i: n for i, (_, n) in want.items()}
    assert {i: r.score for i, r in got.items()} == pytest.approx({i: s for i, (s, _) in want.items()}, abs=1e-9)
    assert all((r.predicted == 1) == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert len({s for s, _ in want.values()}) > 20


def test_toxicity_edges(spark):
    rng = random.Random(1)
    bad, good = ["scum", "vermin", "filth"], [f"plain{chr(97 + i)}" for i in range(20)]
    texts = [(i, " ".join(rng.choices(good, k=30) + (rng.choices(bad, k=12) if i % 3 == 0 else [])), 1 if i % 3 == 0 else 0) for i in range(120)]
    rows = [(i, t) for i, t, _ in texts] + [(0, texts[0][1]), (500, None), (501, ""), (502, "12 !"), (503, " ".join(rng.choices(good, k=200_000)) + " scum vermin filth scum vermin scum filth scum " + " ".join(good)), (None, "scum vermin filth scum vermin scum"), (504, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).withColumn("segs", F.lit(0))
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(1, 0), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = toxicity.score_documents(docs, labels)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r.score)
    assert len(by[0]) == 2 and by[0][0] == by[0][1] >= 0.7
    assert max(by[1]) < 0.3 and by[500] == by[501] == by[502] == by[504]
    assert by[503][0] > by[1][0] and by[None][0] >= 0.7
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


# Language ID


def plain_language_model(rows):
    """(languages, priors, words, n-grams) of (text, lang): a vector of log frequencies less their mean for each entry."""
    words = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for w in plain_words(text):
            words[w][lang] += 1
    langs = sorted({x for c in words.values() for x in c})
    grams = collections.defaultdict(collections.Counter)
    for w, c in words.items():
        p = f"^{w}$"
        for n in range(1, 6):
            for i in range(len(p) - n + 1):
                for lang, k in c.items():
                    grams[p[i : i + n]][lang] += k

    def vectors(counts):
        kept = {w: np.array([c[x] for x in langs], float) for w, c in counts.items() if sum(c.values()) >= 3}
        whole = sum(kept.values()) + 0.5 * len(kept)
        return {w: (v := np.log((c + 0.5) / whole)) - v.mean() for w, c in kept.items()}

    totals = np.array([sum(c[x] for c in words.values()) for x in langs], float)
    return langs, np.log(totals / totals.sum()), vectors(words), vectors(grams)


def plain_language(text, model):
    langs, prior, words, grams = model
    ws = plain_words(text)
    if not ws:
        return "und", 0.0
    total = prior.copy()
    for w in ws:
        row = words.get(w)
        for n in range(5, 0, -1):
            if row is not None:
                break
            known = [grams[g] for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in grams]
            row = np.mean(known, 0) if known else None
        total += 0 if row is None else row
    best = int(np.argmax(total))
    return langs[best], 1 / np.exp(total - total[best]).sum()


def test_language_against_plain_python(spark):
    """All rows of the query: log frequencies of words and n-grams, and the back-off."""
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    model = plain_language_model([(d.text, d.lang) for d in docs if not held[d.doc_id] and d.text is not None and d.lang is not None])
    got = {r.doc_id: r for r in langid.op8_language_id(spark, DATA).collect()}
    for d in docs:
        lang, score = plain_language(d.text, model)
        r = got[d.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, held[d.doc_id])
        assert r.score == pytest.approx(score, abs=1e-4)
    assert len({r.lang_pred for r in got.values()}) > 2


def test_unseen_words_against_plain_python(spark):
    """Words that the model lacks, and mixed texts, where the score lies between 0 and 1."""
    rng = random.Random(8)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(60)]
    known = {"aa": make("abcdef"), "bb": make("efghij"), "cc": make("aeiou")}
    rows = [(" ".join(rng.choices(ws, k=20)), x) for x, ws in known.items() for _ in range(12)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    plain = plain_language_model(rows)
    asked = [(i, " ".join("".join(rng.choices("abcdefghijou", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 4)))) for i in range(300)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, t in asked:
        lang, score = plain_language(t, plain)
        assert got[i][0] == lang, t
        assert got[i][1] == pytest.approx(score, abs=1e-4)


# Edge cases


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0], "x", 1), (0, [3.0, 0.0], "x", 1), (1, [1.0, 0.5], "x", 1), (1, [9.0, 9.0], "x", 1), (1, [1.0, 0.5], "x", 1), (2, [1.0, 0.25], "x", 1), (None, [1.0, 0.0], "x", 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, shard int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(d, d.where("vec_id = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]


def test_chat_edges_of_turns(spark):
    """Equal, repeated and null turns; rows that repeat; an empty role; other columns."""
    t = [(1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 0, "u", "a"), (4, None, "u", "a"), (4, 1, "u", "c"), (5, 0, "u:", "a"), (6, 0, "u", ":a"), (7, 0, None, None)]
    d = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("h", F.lit("x")).withColumn("n", F.lit(1)).withColumn("piece", F.lit(2))
    got = {r.conv_id: r for r in chat.format_chats(d).collect()}
    assert (got[1].n_turns, got[1].n_copies) == (2, 2) and 2 not in got
    assert sorted(re.findall(r"\n(.)<", got[1].rendered)) == ["a", "b"]
    assert (got[3].n_turns, got[3].rendered.count("a<|end|>")) == (2, 2)
    assert got[4].rendered == "<|u|>\na<|end|>\n<|u|>\nc<|end|>\n"
    assert {5, 6, 7} <= got.keys()
    long = spark.createDataFrame([(1, i, "u", "x" * 100) for i in range(3000)] + [(2, i, "u", "x" * 100) for i in range(2999)], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.format_chats(long).collect()] == [(1, 3000)]


def test_secret_scan_edges(spark):
    d = spark.createDataFrame([(1, "token=abcdef"), (None, "token=abcdef")], "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("h", F.lit(2))
    got = {r.doc_id: r.n_assign for r in secrets.report(d).collect()}
    assert got == {1: 1, None: 1}
    assert secrets.report(d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, an empty and a long text, repeats, and columns with clashing names."""
    text = " ".join(f"the{chr(97 + i % 26)} quick" for i in range(40))
    rows = [(1, text, "en", "web", 1), (1, text, "en", "web", 1), (2, None, None, None, None), (3, "", "en", "web", 0), (None, text + " more", "en", None, 1), (4, "quick " * 50_000, "en", "web", 1), (5, "mail a.b@c.org the quick", "en", "web", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("node", "c", "key", "s", "kind", "spans", "fp", "hits", "w"):
        docs = docs.withColumn(name, F.lit(name))
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, odd, k):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, folder = odd
    name, stage = pipeline.STAGES[k]
    ids = lambda d: sorted(str(r.doc_id) for r in d.collect())
    out = stage(spark, docs, folder)
    if k < 4:
        assert out.columns == docs.columns
    want = {"language": ["1", "1", "4", "5", "None"], "near_duplicates": ["1", "1", "2", "3", "4", "5", "None"]}
    assert ids(out) == want.get(name, ["1", "1", "2", "3", "4", "5", "None"])
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_nearest_in_cells(spark, monkeypatch):
    """Clustered vectors: few cells are visited, a crowded cell has several shards, stored graphs serve several blocks of queries."""
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 10
    x = np.concatenate([centres[rng.integers(0, 12, 2400)] + rng.normal(size=(2400, 6)), np.repeat(centres[:1], 600, 0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cells = ann.fit_cells(ann.usable(rows), {6: len(x)}, 250, 10)[6]
    assert len(cells.c) == 12 and cells.probes <= 6
    got = collections.defaultdict(list)
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0"), shard=250).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, len(x), 50):
        d = ann.exact_distances(x, x[q])
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits += len(set(order) & set(got[q]))
    assert hits >= 0.95 * 10 * 60
    assert got[2400][:3] == [2401, 2402, 2403]
