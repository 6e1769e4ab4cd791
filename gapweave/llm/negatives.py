"""Hard negatives by bit-sliced integer products.

Components are integers in two's complement.  Their bit-planes are processed most significant first: the product of the
anchors with a plane is a matrix product with zeros and ones, and what the planes to come can add is bounded by the sums of
an anchor's positive and negative components.  So each candidate has an interval of scores that narrows with each
plane; candidates whose interval misses every wanted window, or lies under as many sure hits as are wanted, are dropped.

Rows and anchors are dealt to blocks of bounded size, and each task takes one block of either.  A block's best come back, and
a window over the blocks picks the best of all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.codes import integers, usable
from gapweave.llm.common import discard, materialize, ship_package, small_batches, table

SCALE = 256
#: Rows, and anchors, of a block at most; blocks of rows while they hold LEAST_ROWS each.
BLOCK, LEAST_BLOCKS, LEAST_ROWS = 32_768, 24, 1024
#: Anchors and rows of a matrix product; share of live candidates from which each anchor goes on with its own.
ANCHORS, ROWS, FEW = 256, 4096, 0.2
_NONE = (1, 0)  # an empty window


def planes(c: np.ndarray) -> list[np.ndarray]:
    """The bit-planes of two's complement integers, least significant first, as zeros and ones."""
    bits = int(max((int(x).bit_length() for x in (c.max(initial=0), -c.min(initial=0))), default=0)) + 1
    kind = object if c.dtype == object else np.float64
    return [((c >> k) & 1).astype(kind) for k in range(bits)]


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    if x.dtype == object:
        return np.sort(x, 1)[:, -k]
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _finish(a, bits, at, s, k, windows, low, high, top):
    """The candidates ``at`` of one anchor through the last k planes, with their exact scores; those that no window wants are
    dropped on the way."""
    while k and len(at):
        k -= 1
        s = s + (bits[k][at] @ a) * 2**k
        rest = 2**k - 1
        lo, hi = s + rest * low, s + rest * high
        wanted = np.zeros(len(at), bool)
        for first, last in windows:
            inside = (hi >= first) & (lo <= last)
            sure = lo[(lo >= first) & (hi <= last)]
            if len(sure) > top:
                inside &= hi >= np.sort(sure)[-top]
            wanted |= inside.astype(bool)
        at, s = at[wanted], s[wanted]
    return at, s


def search(a: np.ndarray, bits: list[np.ndarray], allowed: np.ndarray, windows: list[list[tuple[int, int]]], ids: np.ndarray, top: int):
    """(anchor, window, row, score) of the ``top`` best allowed rows in each window of each anchor, best first, ties by id."""
    n, m = allowed.shape
    kind = bits[0].dtype
    a = a.astype(kind)
    high, low = np.where(a > 0, a, 0).sum(1), np.where(a < 0, a, 0).sum(1)
    some = [[w for w in ws if w[0] <= w[1]] or [_NONE] for ws in windows]
    # No window wants less than the one that ends first does, nor more than the last end.
    least = [min(ws, key=lambda w: (w[1], w[0])) for ws in some]
    floor, first_end = np.array([min(w[0] for w in ws) for ws in some], kind), np.array([w[1] for w in least], kind)
    end = np.array([max(w[1] for w in ws) for ws in some], kind)
    live = allowed & np.array([ws[0] != _NONE for ws in some], bool)[:, None]
    s = np.zeros((n, m), kind)
    k = len(bits)
    while k and live.mean() > FEW:
        k -= 1
        s += (a @ bits[k].T) * (-(2**k) if k == len(bits) - 1 else 2**k)
        rest = 2**k - 1
        lo, hi = s + (rest * low)[:, None], s + (rest * high)[:, None]
        live &= ((hi >= floor[:, None]) & (lo <= end[:, None])).astype(bool)
        sure = live & ((lo >= floor[:, None]) & (hi <= first_end[:, None])).astype(bool)
        if m >= top and (sure.sum(1) >= top).any():
            live &= (hi >= _largest(np.where(sure, lo, -np.inf), top)[:, None]).astype(bool)
    if k == len(bits) and k:  # few are allowed: the sign plane is still to come
        k -= 1
        s += (a @ bits[k].T) * -(2**k)
    out = []
    for i in np.flatnonzero(live.any(1)).tolist():
        at = np.flatnonzero(live[i])
        at, score = _finish(a[i], bits, at, s[i, at], k, windows[i], low[i], high[i], top)
        for w, (first, last) in enumerate(windows[i]):
            q = np.flatnonzero((score >= first) & (score <= last))
            best = q[np.lexsort((ids[at[q]], -score[q]))[:top]]
            out += [(i, w, int(at[j]), int(score[j])) for j in best.tolist()]
    return out


def exact_kind(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python integers where a sum of products may leave the whole numbers of a double."""
    most = [max(1, int(np.abs(x).max(initial=0))) for x in (a, c)]
    if most[0] * most[1] * 4 * max(1, a.shape[1]) >= 1 << 53:
        return a.astype(object), c.astype(object)
    return a.astype(np.int64), c.astype(np.int64)


def vectors_of(t) -> np.ndarray:
    """The integer vectors of an Arrow table."""
    n = t.num_rows
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if hasattr(flat, "flatten") else flat
    return integers(flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0)), SCALE)


def best_of_block(anchors, rows, same: bool, top: int):
    """(anchor_id, wanted, vec_id, score) of a block of anchors, with their windows ``wanted`` as (score of the positive, first,
    last), and a block of rows of the same label, or of others."""
    a, c = exact_kind(vectors_of(anchors), vectors_of(rows))
    aid, rid = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
    al, rl = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    wide = 1 << (4 * max(1, a.shape[1]) * max([1, *(int(np.abs(x).max(initial=0)) for x in (a, c))]) ** 2).bit_length()
    wanted = anchors.column("wanted").to_pylist()
    out = []
    for label in np.unique(al).tolist() if same else [None]:
        mine = np.flatnonzero(al == label) if same else np.arange(len(al))
        own = np.flatnonzero(rl == label) if same else np.arange(len(rl))
        for at in range(0, len(own), ROWS):
            r = own[at : at + ROWS]
            bits = planes(c[r])
            for ai in range(0, len(mine), ANCHORS):
                i = mine[ai : ai + ANCHORS]
                ok = rid[r][None] != aid[i][:, None]
                if not same:
                    ok &= rl[r][None] != al[i][:, None]
                windows = [[(-wide, wide)] if same else [(-(-w // 2), 95 * w // 100) for w in wanted[x]] for x in i]
                for x, w, j, score in search(a[i], bits, ok, windows, rid[r], top):
                    out.append((int(aid[i[x]]), None if same else wanted[i[x]][w], int(rid[r[j]]), score))
    return out


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, same: bool, top: int) -> DataFrame:
    """The best of each pair of blocks."""
    ship_package(rows.sparkSession)
    small_batches(rows.sparkSession)
    down = max(1, math.ceil(n_rows / BLOCK), min(LEAST_BLOCKS, n_rows // LEAST_ROWS))
    across = max(1, math.ceil(n_anchors / BLOCK))
    keys = ("dim", "row_block", "anchor_block")
    deal = lambda name, k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int").alias(name)
    every = lambda name, k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left = rows.select("vec_id", "label", "v", "dim", deal("row_block", down), every("anchor_block", across))
    # Columns under new aliases: a cogroup loses those that both sides take from one table.
    right = anchors.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "v", "dim")], "wanted", deal("anchor_block", across), every("row_block", down))
    # More parts than keys, so that few keys share a task; a number that is given isn't lowered at run time.
    left, right = (d.repartition(4 * down * across, *keys) for d in (left, right))

    def run(own, asked):
        import pyarrow as pa

        out = best_of_block(asked, own, same, top) if own.num_rows and asked.num_rows else []
        names = ("anchor_id", "wanted", "vec_id", "score")
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "anchor_id long, wanted long, vec_id long, score long")


def _top(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: str, n_positives: int = 5, n_negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that the condition ``anchor`` picks
    and each of its best rows of the same label, the best rows of other labels with half to 95 % of the positive's score.

    ``vectors`` has vec_id, embedding and label.  Rows with a null in vec_id, label or vector, or a component that isn't finite, take no part;
    only vectors of one length meet.  Equal scores go to the smaller vec_id.  Rows that repeat a vec_id are one row, that of the least label
    and vector.  An anchor without positives, and a positive without fitting negatives, have no rows, nor has an empty
    table; other columns are not read.  Scores are exact at any magnitude; one beyond 64 bits raises."""
    rows = usable(vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")).alias("r"))
    rows = rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))
    rows = materialize(rows, "vectors")
    anchors = rows.where(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    near = _blocks(rows, anchors.withColumn("wanted", F.array().cast("array<long>")), n_rows, n_anchors, True, n_positives)
    positives = materialize(_top(near.drop("wanted"), ("anchor_id",), n_positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most n_positives scores for each anchor.
    wanted = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("wanted"))
    asked = anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    far = _top(_blocks(rows, asked, n_rows, n_anchors, False, n_negatives), ("anchor_id", "wanted"), n_negatives)
    far = far.select("anchor_id", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = materialize(positives.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for done in (rows, positives):
        discard(done)
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS LONG) + 1) % 10 ELSE label END").alias("label"))
    return mine(vectors, "vec_id % 50 = 0")


OP13_SQL = """
WITH base AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS MATERIALIZED (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
