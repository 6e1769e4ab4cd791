"""SimHash groups, product codes and hard negatives against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import codes, negatives, simhash
from gapweave.llm.common import table
from tests.oracle import DATA


def plain_fingerprint(text, n):
    import xxhash

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    k = min(n, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius=4):
    """{i: least i reachable} of {i: fingerprint}."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("cell", "part"), [(simhash.CELL, simhash.PART), (3, 2)])
def test_links_of_points(spark, monkeypatch, cell, part):
    """Planted chains at 1 to 6 bits, also where each cell is cut again and dealt to parts."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(11)
    points = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            points.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    center = rng.getrandbits(64)
    points |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(150)}
    prints = {signed(p): p for p in points}
    want = plain_groups(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for groups in (6, 8):
        monkeypatch.setattr(simhash, "groups_for", lambda n, r, g=groups: g)
        got = {i: i for i in prints} | dict(simhash.point_components(df).collect())
        assert got == want


def test_simhash_of_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    prints = {i: plain_fingerprint(t, 4) for i, t in texts.items()}
    want = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert any(i != c for i, c in want.items())


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(7, None), (3, ""), (5, " \n"), (1, "a b C"), (2, "A b c"), (2, "A b c"), (None, "a b c"), (9, long), (10, "X" * 2_500_000), (11, long + " tail"), (12, "é à\x1cb\xa0c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("cell", F.lit(1))
    got = simhash.groups(docs, n=4)
    assert got.columns == ["doc_id", "fp", "component_id", "kept"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    want = plain_groups({i: plain_fingerprint(t, 4) for i, t in rows if i is not None})
    assert {i: c for i, c in want.items()} == {i: v[0][1] for i, v in by.items() if i is not None}
    assert all(v[0][0] == signed(plain_fingerprint(t, 4)) for i, t in rows for v in [by[i]])
    assert by[None][0][1] is None and len(by[2]) == 2 and len(set(by[2])) == 1
    assert by[7][0] == by[3][0] == by[5][0] == (0, 3)
    kept = simhash.drop_near_duplicates(docs, n=4)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "10", "12", "3", "9", "None"])
    assert simhash.groups(docs.limit(0)).count() == 0


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{row number: (codes, error)} and the codebooks of integer vectors in the order of their ids."""
    width = len(rows[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in rows] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def assign():
        best = [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book)) for x in c] for c, book in zip(cut, books, strict=True)]
        return best

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [x for x, (_, j) in zip(cut[p], found[p], strict=True) if j == i]
                if mine:
                    books[p][i] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    found = assign()
    return [("".join(f"{found[p][n][1]:02x}" for p in range(parts)), sum(found[p][n][0] for p in range(parts))) for n in range(len(rows))], books


VECTORS = "vec_id long, embedding array<double>, label int, codes string, v int"


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12])
def test_product_codes(spark, scale):
    rng = random.Random(12)
    odd = [(None, [0.25] * 16, 1, "x", 0), (3, None, 1, "x", 0), (4, [float("nan")] + [0.0] * 15, 1, "x", 0), (5, [None] + [0.0] * 15, 1, "x", 0), (6, [float("inf")] + [0.0] * 15, 1, "x", 0)]
    some = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([None, 1, 2]), "x", 0) for i in range(10, 130)]
    if scale < 1e12:
        some += [(i + 200, [scale * rng.gauss(0, 1) for _ in range(16)], 3, "x", 0) for i in range(30)]
    some += some[:7]
    kept = sorted(some, key=lambda r: (r[0], r[1])) + odd[:1]
    vectors = spark.createDataFrame(odd + some, VECTORS).repartition(5)
    if scale == 1e12:  # rows too far for 64-bit squares but for their own entries
        kept = [(i, [scale * (i + 1)] * 16, 1, "x", 0) for i in range(5)]
        vectors = spark.createDataFrame(kept, VECTORS)
    ints = [[int((4096 * x) // 1) for x in r[1]] for r in kept]
    want, books = plain_codes(ints)
    coded, got_books = codes.compress(vectors, keep=("vec_id", "label"))
    got = [(r.vec_id, bytes(r.codes).hex(), r.error) for r in coded.collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(got, key=key) == sorted(((r[0], *w) for r, w in zip(kept, want, strict=True)), key=key)
    assert codes.digest(got_books) == codes.digest([np.array(b, object) for b in books])
    near = {r.vec_id: r.embedding for r in codes.restore(coded, got_books).collect()}
    i, code = next((r[0], w[0]) for r, w in zip(kept, want, strict=True))
    assert near[i] == pytest.approx([x / 4096 for p in range(8) for x in books[p][int(code[2 * p : 2 * p + 2], 16)]])


def test_product_codes_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.compress(none)[0].count() == 0
    one = spark.createDataFrame([(1, [0.5] * 8, None, "x", 0)], VECTORS)
    assert [(r.vec_id, bytes(r.codes), r.error) for r in codes.compress(one)[0].collect()] == [(1, bytes(8), 0)]
    for sizes in ((8, 16), (12, 12)):
        with pytest.raises(ValueError, match="equal parts"):
            codes.compress(spark.createDataFrame([(i, [0.5] * n, 1, "x", 0) for i, n in enumerate(sizes)], VECTORS))


def plain_negatives(rows, anchor, n_pos=5, n_neg=3):
    out = []
    ints = {i: ([int((256 * x) // 1) for x in v], label) for i, v, label in rows}
    for i, (a, label) in ints.items():
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, c, strict=True)), j) for j, (c, _) in ints.items() if j != i and len(c) == len(a))
        positives = [(j, -s) for s, j in scored if ints[j][1] == label][:n_pos]
        for p, sp in positives:
            fits = [(j, -s) for s, j in scored if ints[j][1] != label and 50 * sp <= -100 * s <= 95 * sp]
            out += [(i, p, r, j, sp, s) for r, (j, s) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "size"), [(1, 16), (1, 1), (1000, 16), (1e6, 5)])
def test_hard_negatives(spark, monkeypatch, scale, size):
    """Also with ties, small blocks and scores beyond the whole numbers of a double."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rng = random.Random(13)
    rows = [(i, [scale * rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(size)], rng.randrange(4)) for i in range(300)]
    rows += [(i, rows[17][1], rng.randrange(4)) for i in range(300, 400)]
    odd = [(None, [1.0] * size, 1), (900, None, 1), (902, [float("nan")] * size, 1), (904, [None] * size, 2), (906, [1.0] * size, None), (908, [1.0] * (size + 1), 1), (910, [1.0] * (size + 1), 1), (912, [0.7] * (size + 1), 2)]
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows + odd + rows[:9]], VECTORS)
    got = sorted(tuple(r) for r in negatives.mine(df, "vec_id % 2 = 0").collect())
    assert got == plain_negatives(rows + odd[5:], lambda i: i % 2 == 0)
    assert got


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([(2, [1.0], 1, "x", 0)], VECTORS)
    assert negatives.mine(df, "vec_id % 2 = 0").count() == 0
    assert negatives.mine(df.limit(0), "vec_id % 2 = 0").count() == 0
