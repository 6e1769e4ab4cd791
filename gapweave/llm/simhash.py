"""Near duplicates by SimHash, found through a segment-popcount embedding.

1. A text's fingerprint has the bits that more than half of its shingle hashes (XXH64) have.
2. Equal fingerprints collapse into a point.  The 64 bits are cut into 32 segments of two, and a point's coordinates are
   the bit counts of its segments.  The Manhattan distance of two points never exceeds their Hamming distance.
3. Grid range-join: the coordinates are cut into g groups.  Points within Manhattan distance r differ in r groups at
   most, so in one of the projections to g - r groups both lie in the same grid cell (side 1).  Each point goes to one
   cell for each projection; a crowded cell is cut again by the coordinates that it leaves open.
4. In each cell the points first meet its least one; the links give components, and only points of different components
   meet then, under the Manhattan bound and an exact count of the differing bits.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import discard, map_rows, materialize, table
from gapweave.llm.graph import components

SEED = 42
#: Bytes of text that are cut into words, and shingles whose bits are counted, at once.
BLOCK, SHINGLES = 1 << 20, 1 << 14
#: Two-bit segments of a fingerprint; bits that tell two of their counts apart, on average over random ones.
SEGMENTS, SEGMENT_BITS = 32, 1.415
#: Random points that may share a cell: meeting one costs about a hundredth of being sent to one more cell.
SHARED = 64
#: Points up to which a cell isn't cut again, and groups of the second cut beyond the radius.
CELL, CUT = 256, 2
#: Points outside a cell's largest component that meet all its others in one task.
PART = 512
_ODD = 0x5555555555555555
_WHITE = re.compile(rb"[ \t-\r]")


def _pieces(raw: bytes):
    """Lists of words; long texts are cut at white space."""
    at = 0
    while at < len(raw):
        m = _WHITE.search(raw, at + BLOCK) if at + BLOCK < len(raw) else None
        end = m.start() if m else len(raw)
        yield raw[at:end].split()
        at = end


def shingle_hashes(words: list[bytes], k: int):
    """Arrays of the hashes of each k consecutive words, joined by a space."""
    import xxhash

    digest, text = xxhash.xxh64_intdigest, memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    for at in range(0, len(words) - k + 1, SHINGLES):
        to = min(at + SHINGLES, len(words) - k + 1)
        spans = zip(start[at:to].tolist(), end[at + k - 1 : to + k - 1].tolist(), strict=True)
        yield np.fromiter((digest(text[s:e], SEED) for s, e in spans), np.uint64, to - at)


def fingerprint(text: str | None, n: int) -> int:
    """The SimHash, as a signed number; zero without words.  Fewer than n words are one shingle."""
    counts, total, held = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + piece
        if len(words) >= n:
            for h in shingle_hashes(words, n):
                counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                total += len(h)
            words = words[len(words) - n + 1 :]
        held = words
    if not total and held:
        h = next(shingle_hashes(held, len(held)))
        return int(h.view(np.int64)[0])
    bits = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def rows(batch):
        return [(doc_id, fingerprint(text, n)) for doc_id, text in batch]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), rows, f"doc_id {kind}, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the segments, two bits each (a half adder; signed differences would overflow)."""
    up = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(_ODD)), 1).bitwiseOR(fp.bitwiseXOR(up).bitwiseAND(F.lit(_ODD)))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two packed count vectors: unequal counts that differ in the low bit are 1 apart, others 2."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(F.lit(_ODD))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_ODD))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def projections(segments: list[int], groups: int, radius: int) -> list[list[int]]:
    """The segments of each choice of groups - radius groups of neighbouring segments."""
    cut = [list(g) for g in np.array_split(segments, groups)]
    return [[int(s) for g in chosen for s in g] for chosen in itertools.combinations(cut, groups - radius)]


def _mask(segments: list[int]) -> int:
    return _signed(sum(3 << 2 * s for s in segments))


def groups_for(points: int, radius: int) -> int:
    """The least number of groups by which SHARED random points at most share a cell; any number gives the same links."""
    for g in range(radius + 2, radius + 4):
        if points <= SHARED * 2 ** (SEGMENT_BITS * (SEGMENTS * (g - radius) // g)):
            return g
    return radius + 4


def _cells(points: DataFrame, radius: int, groups: int) -> DataFrame:
    """(cell, fp, u) of the cells with more than one point; u is the least of the cell.  A cell is known by the
    hash of its coordinates; two that share one only make candidates, which are tested exactly."""
    every = list(range(SEGMENTS))
    first = projections(every, groups, radius)
    masks = F.array(*(F.lit(_mask(p)) for p in first))
    second = F.array(*(F.array(*(F.lit(_mask(q)) for q in projections([s for s in every if s not in p], radius + CUT, radius))) for p in first))

    def crowds(cells: DataFrame) -> DataFrame:
        return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("u")).where("m > 1")

    e = segment_counts(F.col("fp"))
    coarse = points.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.xxhash64("t", e.bitwiseAND(F.col("mask"))).alias("cell"))
    coarse = materialize(coarse.join(crowds(coarse), "cell"), "cells")
    crowded = coarse.where(F.col("m") > CELL).select("fp", "cell", F.posexplode(F.element_at(second, F.col("t") + 1)).alias("t2", "mask"))
    fine = crowded.select("fp", F.xxhash64("cell", "t2", e.bitwiseAND(F.col("mask"))).alias("cell"))
    fine = fine.join(crowds(fine), "cell")
    out = materialize(coarse.where(F.col("m") <= CELL).select("cell", "fp", "u").unionByName(fine.select("cell", "fp", "u")), "cells")
    discard(coarse)
    return out


def _near(a: str, b: str, radius: int) -> Column:
    a, b = F.col(a), F.col(b)
    return (manhattan(segment_counts(a), segment_counts(b)) <= radius) & (hamming(a, b) <= radius)


def _across(cells: DataFrame, parts: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between different components c.  In a cell, the largest component isn't paired with itself; the
    other points are dealt to parts that each meet the rest in a task of their own."""
    placed = cells.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left").select("cell", "fp", F.coalesce("c", "fp").alias("c"))
    by = placed.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("m"))
    most = by.groupBy("cell").agg(F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("n")).where("k > 1")
    most = most.select("cell", F.col("x.c").alias("big"), F.ceil((F.col("n") - F.col("x.m")) / PART).alias("parts"))
    live = materialize(placed.join(most, "cell"), "cells")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    other = live.select("cell", part, F.col("fp").alias("v"), F.col("c").alias("d"), F.col("big").alias("v_big"))
    outside = live.where("c != big").select("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"), F.col("fp").alias("u"), "c")
    pairs = outside.join(other, ["cell", "part"]).where((F.col("c") != F.col("d")) & ((F.col("d") == F.col("v_big")) | (F.col("u") < F.col("v"))) & _near("u", "v", radius))
    links = materialize(pairs.select("u", "v").distinct(), "links")
    discard(live)
    return links


def point_components(points: DataFrame, radius: int = 4) -> DataFrame:
    """(node, component) of the distinct fingerprints ``fp`` that a chain of links reaches, each of ``radius``
    differing bits at most.  Points without a link have no row."""
    cells = _cells(points, radius, groups_for(points.count(), radius))
    stars = materialize(cells.where((F.col("fp") != F.col("u")) & _near("fp", "u", radius)).select("u", F.col("fp").alias("v")).distinct(), "stars")
    parts = materialize(components(stars), "parts")
    late = _across(cells, parts, radius)
    if late.limit(1).count():
        discard(parts)
        parts = materialize(components(stars.union(late)), "parts")
    for done in (cells, stars, late):
        discard(done)
    return parts


def groups(docs: DataFrame, n: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, kept) of every row.

    Texts count whole; null and empty ones, and those without words, have fingerprint zero and are linked like any other.
    The component is the least doc_id that links reach, so ties and repeated rows need no order.  Rows with a null doc_id
    make no links; their component is null and they are kept.  An empty table gives no rows; other columns are not read."""
    prints = materialize(fingerprints(docs, n), "fingerprints")
    points = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = point_components(points.select("fp"), radius)
    placed = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    whole = placed.join(least, "c").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return prints.join(whole, "fp", "left").select("doc_id", "fp", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, radius: int = 4) -> DataFrame:
    """One document of each group, all columns kept: the one with the least doc_id (each row that has it)."""
    gone = groups(docs, n, radius).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), n=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
