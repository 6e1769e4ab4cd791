"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes the set of its word shingles (64-bit hashes), a 128-bit digest of that set,
   band keys over MinHash minima, and the low bits of the minima packed into a signature.
2. Equal sets collapse into a class, so copies never meet in pairs.
3. Classes that share a band key are candidates.  A bucket is first tested as a star around its least
   member; after the components are known, members of different components in a bucket are
   compared by their rarest shingles.  Signatures give a collision-corrected estimate of the similarity by
   counting bits, which drops pairs far below the threshold.
4. What is left is confirmed on the full sets.  Components of confirmed links are the groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import discard, map_rows, materialize, table
from gapweave.llm.graph import components
from gapweave.llm.texthash import mix, shingle_set, word_hashes

#: 24 bands of 4 minima find a pair at similarity 0.8 with probability 1 - 3e-6.
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Low bits kept of each minimum; two random ones agree with probability 2 ** -BITS.
BITS = 2
#: Standard deviations of the estimate under the threshold up to which a pair stays.
SLACK = 5.0
#: Largest number of node ids that is broadcast (8 bytes each); more are shuffled.
BROADCAST_ROWS = 400_000
#: Rows of one shingle that meet all its other rows in one task.
PART = 512

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The K minima (32 bits) of a non-empty set of hashes, in blocks of bounded size."""
    out = np.full(K, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 512):
        x = ((hashes[at : at + 512, None] ^ _XOR) * _MUL) >> np.uint64(32)
        np.minimum(out, x.min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + m.reshape(BANDS, ROWS)[:, r])
    return h.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS of the minima, 64 // BITS to a word."""
    low = (m & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def text_set(text: str | None, n: int) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode("utf-8", "surrogatepass").lower()), n)


def features(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, s1, s2, bands, sig) of every document; without words n is 0 and the rest null."""

    def rows(batch):
        out = []
        for doc_id, text in batch:
            s = text_set(text, n)
            if not len(s):
                out.append((doc_id, 0, None, None, None, None))
                continue
            d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            m = minima(s)
            out.append((doc_id, len(s), int(d[0]), int(d[1]), band_keys(m).tolist(), packed(m).tolist()))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n long, s1 long, s2 long, bands array<long>, sig array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: the share of equal low bits, corrected for chance."""
    words = K * BITS // 64
    pairs = (1 << 64) // 3 if BITS == 2 else None  # 0101...
    low = F.lit(pairs)
    differ = None
    for i in range(words):
        x = a[i].bitwiseXOR(b[i])
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
        differ = one if differ is None else differ + one
    chance = 2.0**-BITS
    return ((1 - differ / K) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SLACK * float(np.sqrt(p * (1 - p) / K)) / (1 - chance)


def _promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow the similarity."""
    a = classes.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("sig").alias("us"))
    b = classes.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("sig").alias("vs"))
    return (
        pairs.join(b, "v")
        .join(a, "u")
        .where((F.least("un", "vn") >= threshold * F.greatest("un", "vn")) & (estimate(F.col("us"), F.col("vs")) >= least_estimate(threshold)))
        .select("u", "v")
    )


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, s): the shingle sets of the given nodes."""
    picked = nodes.select(F.col("node").alias("_node"))
    if nodes.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    d = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_node"), "left_semi")

    def rows(batch):
        return [(doc_id, text_set(text, n).tobytes()) for doc_id, text in batch]

    return map_rows(d, rows, f"node {docs.schema['doc_id'].dataType.simpleString()}, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    a = sets.select(F.col("node").alias("u"), F.col("s").alias("us"))
    b = sets.select(F.col("node").alias("v"), F.col("s").alias("vs"))

    def rows(batch):
        out = []
        for u, v, us, vs in batch:
            x, y = np.frombuffer(us, np.uint64), np.frombuffer(vs, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((u, v))
        return out

    kind = pairs.schema["u"].dataType.simpleString()
    return map_rows(pairs.join(b, "v").join(a, "u").select("u", "v", "us", "vs"), rows, f"u {kind}, v {kind}")


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two written tables follow the pairs (u, v) of ``rest`` (node, c) in different components c that can still be similar enough.

    Two sets that are share a shingle among the rarest of each, the first size - ceil(percent of size) + 1
    in order of their counts.  What a large group has in common is frequent there, so a text that
    differs from a group in more than that meets none of it.  For each shingle, the component with most
    rows is never paired with itself, and its other rows are dealt to parts of about PART rows that each meet
    the rest in a task of their own."""
    kind = rest.schema["node"].dataType.simpleString()

    def rows(batch):
        out = []
        for node, c, s in batch:
            x = np.frombuffer(s, np.int64)
            first = len(x) - -(-percent * len(x) // 100) + 1
            out.append((node, c, len(x), first, x.tolist()))
        return out

    with_sets = rest.join(sets, "node").select("node", "c", "s")
    each = map_rows(with_sets, rows, f"node {kind}, c {kind}, n long, first long, ts array<long>")
    tokens = materialize(each.select("node", "c", "n", "first", F.explode("ts").alias("t")), "shingles")
    shared = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    seen = tokens.join(shared, "t")
    w = Window.partitionBy("node")
    ranked = seen.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("df", "t")))
    prefix = materialize(ranked.where("r <= first - alone").select("node", "c", "n", "t", (F.col("alone") + F.col("r") - 1).alias("p")), "prefixes")
    by = prefix.groupBy("t", "c").agg(F.count(F.lit(1)).alias("m"))
    most = by.groupBy("t").agg(F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("rows")).where("k > 1")
    most = most.select("t", F.col("x.c").alias("big"), F.ceil((F.col("rows") - F.col("x.m")) / PART).alias("parts"))
    live = prefix.join(most, "t")
    other = live.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("b"), F.col("c").alias("d"), F.col("n").alias("bn"), F.col("p").alias("bp"), F.col("big").alias("b_big"))
    # What can still be common from the first common shingle on must reach the intersection needed.
    near = f"least(n, bn) * 100 >= {percent} * greatest(n, bn) AND (n - p) * {100 + percent} >= (n + bn) * {percent} AND (bn - bp) * {100 + percent} >= (n + bn) * {percent}"
    # Both outside the largest component: one order of the pair; one inside: the outsider comes first.
    first = live.where("c != big").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = first.join(other, ["t", "part"]).where(f"c != d AND (d = b_big OR node < b) AND {near}")
    return pairs.select(F.least("node", "b").alias("u"), F.greatest("node", "b").alias("v")).distinct(), tokens, prefix


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    The component is the least doc_id that links reach.  Texts without words (null and empty ones too)
    are linked with nothing.  Rows with a null doc_id keep a null component and are kept.  Rows
    that repeat a doc_id are one document to the links.  Texts count whole; an empty table gives no rows, other
    columns are not read."""
    threshold = percent / 100
    feats = materialize(features(docs, n), "minhash")
    live = feats.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        live.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "sig", "bands")).alias("r")).select("s1", "s2", F.col("r.doc_id").alias("node"), "r.n", "r.sig", "r.bands"),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "node")
    buckets = banded.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u != top").select("key", "u")
    members = materialize(banded.join(buckets, "key").select("key", "u", F.col("node").alias("v")), "buckets")

    stars = materialize(_promising(members.where("u != v").select("u", "v").distinct(), classes, threshold), "stars")
    nodes = materialize(members.select(F.col("v").alias("node")).distinct(), "candidates")
    sets = materialize(_sets(docs, nodes, n), "sets")
    links = materialize(_confirmed(stars, sets, percent), "links")
    parts = materialize(components(links), "parts")

    # Members of a bucket that are still in different components.
    placed = members.join(parts.select(F.col("node").alias("v"), F.col("component").alias("c")), "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    rest = materialize(placed.join(split, "key").select(F.col("v").alias("node"), "c").distinct(), "rest")
    across, *written = _across(rest, sets, percent)
    more = across.join(stars, ["u", "v"], "left_anti")
    late = materialize(_confirmed(_promising(more, classes, threshold), sets, percent), "links")
    if late.limit(1).count():
        discard(parts)
        parts = materialize(components(links.union(late)), "parts")
    for done in (members, stars, nodes, sets, links, rest, late, *written):
        discard(done)

    whole = classes.select("s1", "s2", "node").join(parts, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    return (
        feats.select("doc_id", "n", "s1", "s2")
        .join(whole, ["s1", "s2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns kept: the one with the least doc_id (each row that has it)."""
    gone = groups(docs, n, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), n=4)
