"""Nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Vectors are dealt to cells by their nearest of some centres, which are fitted on a bounded sample; a cell too large for one
shard is dealt to several by the hash of the id.  A shard's graph, a flat array of neighbour numbers for each layer, is built
once and stored; many searches go through it in step with numpy, in double precision.  A query visits the shards of its
nearest cells, of as many as hold KEEP of the neighbours within the sample: few where the vectors lie in clusters, all where they
don't.  The best of all visits, measured exactly, are its result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import discard, map_batches, materialize, ship_package, slices, small_batches, table

#: Mean number of vectors in a full shard (of 100 dimensions: 52 MB), least number of shards, and of vectors
#: for which one more is opened until that number is reached.
SHARD, LEAST_SHARDS, LEAST_ROWS = 65_536, 8, 256
#: Queries that meet a shard at once; a further block of them reads its stored graph again.
QUERIES = 65_536
#: The sample for centres and probes: at most so many vectors, and bytes.  A centre has SUPPORT of them at least, so the centres are
#: bounded too.
SAMPLE, SAMPLE_BYTES, SUPPORT, ROUNDS = 20_000, 32 << 20, 16, 8
#: Sample queries that choose the number of probes, and share of their neighbours that the probed cells must hold.
TRIALS, KEEP = 256, 0.99
#: Links of a node in the upper layers; twice as many in the lowest.
M = 16
#: Breadth of the search while building and for queries.
EF_BUILD, EF_SEARCH = 64, 128
#: Nodes that are inserted, and queries that search, in step; nodes that a search opens in a step.
BATCH, OPEN = 256, 4


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[ids[i, j]]."""
    d = x[ids] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _walk(x, links, q, entry, ef):
    """(ids, squared distances), nearest first, of ``ef`` nodes found from the entry of each query;
    missing ones have id -1.  All queries take a step at a time."""
    b, n = len(q), len(x)
    ids = np.full((b, ef), -1, np.int32)
    dist = np.full((b, ef), np.inf, x.dtype)
    fresh = np.zeros((b, ef), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], fresh[:, 0] = entry, True
    dist[:, 0] = _distances(x, q, entry[:, None])[:, 0]
    seen[np.arange(b), entry] = True
    most = min(OPEN, ef)
    while True:
        rows = np.flatnonzero(fresh.any(1))
        if not len(rows):
            return ids, dist
        take = np.arange(len(rows))[:, None]
        # Lists are sorted, so the first fresh places are the nearest.
        at = np.argsort(~fresh[rows], 1, kind="stable")[:, :most]
        opened = fresh[rows[:, None], at]
        fresh[rows[:, None], at] = False
        nb = np.where(opened[:, :, None], links[ids[rows[:, None], at]], -1).reshape(len(rows), -1)
        nb.sort(1)
        ok = nb >= 0
        ok[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        ok &= ~seen[rows[:, None], nb]
        wide = int(ok.sum(1).max())
        front = np.argsort(~ok, 1, kind="stable")[:, :wide]
        nb, ok = np.where(ok, nb, 0)[take, front], ok[take, front]
        seen[rows[:, None], nb] |= ok
        d = np.where(ok, _distances(x, q[rows], nb), np.inf)
        all_d = np.concatenate([dist[rows], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :ef]
        dist[rows] = all_d[take, order]
        ids[rows] = np.concatenate([ids[rows], np.where(ok, nb, -1)], 1)[take, order]
        fresh[rows] = np.concatenate([fresh[rows], ok], 1)[take, order]


def _diverse(x: np.ndarray, node: int, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours, nearest first: those nearer to the node than to any chosen one, then the
    nearest of the rest."""
    ids = ids[:96]
    if len(ids) <= 1:
        return ids
    v = x[ids] - x[node]
    sq = np.einsum("ij,ij->i", v, v)
    pair = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    blocked = np.zeros(len(ids), bool)
    chosen = []
    for i in range(len(ids)):
        if not blocked[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            blocked |= pair[i] < dist[: len(ids)]
    if len(chosen) < most:
        rest = np.ones(len(ids), bool)
        rest[chosen] = False
        chosen += np.flatnonzero(rest)[: most - len(chosen)].tolist()
    return ids[np.sort(chosen)]


class Graph:
    """HNSW over distinct vectors."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x = np.ascontiguousarray(x)
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / math.log(M)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        self.level, self.entry = level, int(order[0])
        self.links = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(level.max()) + 1)]
        at = 1
        while at < n:
            batch = order[at : at + min(at, BATCH)]
            self._insert(batch, level)
            at += len(batch)

    @classmethod
    def of(cls, x: np.ndarray, links: list[np.ndarray], entry: int) -> Graph:
        """A stored graph over its vectors."""
        g = cls.__new__(cls)
        g.x, g.links, g.entry = np.ascontiguousarray(x), links, entry
        return g

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        entry = np.full(len(q), self.entry, np.int32)
        for k in range(len(self.links) - 1, to, -1):
            entry = _walk(self.x, self.links[k], q, entry, 1)[0][:, 0]
        return entry

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        x = self.x
        q = x[batch]
        entry = np.full(len(batch), self.entry, np.int32)
        for k in range(len(self.links) - 1, -1, -1):
            here = level[batch] >= k
            up = np.flatnonzero(~here)
            if len(up):
                entry[up] = _walk(x, self.links[k], q[up], entry[up], 1)[0][:, 0]
            mine = np.flatnonzero(here)
            if not len(mine):
                continue
            ids, dist = _walk(x, self.links[k], q[mine], entry[mine], EF_BUILD)
            entry[mine] = ids[:, 0]
            # Nodes of the same batch don't see each other in the graph yet.
            own = batch[mine].astype(np.int32)
            v = x[own]
            among = np.concatenate([_distances(x, v[i : i + 32], np.broadcast_to(own, (len(v[i : i + 32]), len(own)))) for i in range(0, len(own), 32)])
            np.fill_diagonal(among, np.inf)
            near = np.argsort(among, 1, kind="stable")[:, :M]
            ids = np.concatenate([ids, own[near]], 1)
            dist = np.concatenate([dist, np.take_along_axis(among, near, 1)], 1)
            by = np.argsort(dist, 1, kind="stable")
            ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            links, most = self.links[k], self.links[k].shape[1]
            back: dict[int, list[int]] = {}
            for i, node in enumerate(own):
                ok = (ids[i] >= 0) & np.isfinite(dist[i])
                chosen = _diverse(x, node, ids[i][ok], dist[i][ok], M)
                links[node, : len(chosen)] = chosen
                for c in chosen.tolist():
                    back.setdefault(c, []).append(int(node))
            for c, nodes in back.items():
                have = links[c][links[c] >= 0]
                both = np.unique(np.concatenate([have, np.array(nodes, np.int32)]))
                if len(both) > most:
                    d = x[both] - x[c]
                    d = np.einsum("ij,ij->i", d, d)
                    o = np.argsort(d, kind="stable")
                    both = _diverse(x, c, both[o], d[o], most)
                links[c] = -1
                links[c, : len(both)] = both

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the ``ef`` nearest nodes found for each query, -1 where fewer."""
        ids, dist = [], []
        for at in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[at : at + BATCH])
            i, d = _walk(self.x, self.links[0], part, self._descend(part, 0), ef)
            ids.append(i)
            dist.append(d)
        return np.concatenate(ids), np.concatenate(dist)


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of q to the rows of x; scaled by powers of two, so squares never leave the doubles."""
    d = x - q
    e = np.frexp(np.abs(d).max(1, initial=0.0))[1]
    return np.ldexp(np.sqrt((np.ldexp(d, -e[:, None]) ** 2).sum(1)), e)


def comparable(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both scaled by one power of two to at most 1; with components so small beside the largest that their
    squares would vanish, as numbers of a wider exponent."""
    e = int(max(np.frexp(np.abs(v).max(initial=0.0))[1] for v in (x, q)))
    small = min((np.abs(v[v != 0]).min(initial=np.inf) for v in (x, q)), default=np.inf)
    if np.frexp(small)[1] - e < -450:
        return np.ldexp(x.astype(np.longdouble), -e), np.ldexp(q.astype(np.longdouble), -e)
    return np.ldexp(x, -e), np.ldexp(q, -e)


def build_shard(ids: np.ndarray, x: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The flat arrays of a shard: the distinct vectors, the least k + 1 ids of each (no more can be wanted), and the graph."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order] + 0.0  # no negative zero
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    by = np.argsort(inverse.ravel(), kind="stable")
    node = inverse.ravel()[by]
    place = np.arange(len(by)) - np.searchsorted(node, node)
    by = by[place <= k]
    start = np.searchsorted(inverse.ravel()[by], np.arange(len(first) + 1))
    g = Graph(comparable(x[first], x[:0])[0])
    out = {"x": x[first], "ids": ids[by], "start": start, "entry": np.array(g.entry), "links0": g.links[0]}
    for i, links in enumerate(g.links[1:], 1):
        at = np.flatnonzero(g.level >= i).astype(np.int32)
        out |= {f"at{i}": at, f"links{i}": links[at]}
    return out


def search_built(shard: dict, qids: np.ndarray, q: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k nearest of a shard, its own row left out."""
    x, ids, start = shard["x"], shard["ids"], shard["start"]
    nodes, asked = comparable(x, q)
    links = [shard["links0"]]
    for i in range(1, sum(name.startswith("at") for name in shard) + 1):
        wide = np.full((len(x), shard[f"links{i}"].shape[1]), -1, np.int32)
        wide[shard[f"at{i}"]] = shard[f"links{i}"]
        links.append(wide)
    found, _ = Graph.of(nodes, links, int(shard["entry"])).search(asked, EF_SEARCH)
    out = []
    for i, qid in enumerate(qids):
        f = found[i][found[i] >= 0]
        at = np.concatenate([np.arange(start[n], start[n + 1]) for n in f]) if len(f) else np.zeros(0, int)
        node = np.repeat(f, start[f + 1] - start[f]) if len(f) else at
        other = ids[at] != qid
        at, node = at[other], node[other]
        d = exact_distances(x[node], q[i])
        best = np.lexsort((ids[at], d))[:k]
        out += [(int(qid), int(ids[at[j]]), float(d[j])) for j in best]
    return out


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int):
    """A shard built and searched at once."""
    return search_built(build_shard(ids, x, k), qids, q, k)


def squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q to those of c."""
    return np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * q @ c.T, 0)


class Cells:
    """Centres of one vector length, the power of two that brings their coordinates to 1 at most, and the number of cells to
    visit."""

    def __init__(self, sample: np.ndarray, wanted: int, k: int):
        rng = np.random.default_rng(5)
        self.e = int(np.frexp(np.abs(sample).max(initial=0.0))[1])
        x = np.unique(np.ldexp(sample, -self.e), axis=0)
        n = max(1, min(wanted, len(x) // SUPPORT))
        self.c = x[rng.choice(len(x), n, replace=False)] if len(x) else np.zeros((1, sample.shape[1]))
        for _ in range(ROUNDS if n > 1 else 0):
            own = squares(x, self.c).argmin(1)
            count = np.bincount(own, minlength=n)
            sums = np.zeros_like(self.c)
            np.add.at(sums, own, x)
            self.c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.c)
        self.probes = 1
        if n > 1:
            t = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
            near = np.argsort(squares(x[t], x), 1)[:, 1 : k + 1]
            rank = np.argsort(np.argsort(squares(x[t], self.c), 1), 1)
            ranks = np.take_along_axis(rank, squares(x, self.c).argmin(1)[near], 1)
            # The nearest rows of a sample are further away than those of the whole table, so this errs upwards.
            self.probes = int(np.quantile(ranks, KEEP, method="higher")) + 1

    def nearest(self, v: np.ndarray, most: int) -> np.ndarray:
        """The numbers of the ``most`` nearest centres of each vector, nearest first."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = squares(np.ldexp(v, -self.e), self.c)
        return np.argsort(np.nan_to_num(d, nan=np.inf), 1, kind="stable")[:, :most]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the rows that take part: not null, not zero, all components finite."""
    v = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    return v.where(fine).select("vec_id", "v", F.size("v").alias("dim"))


def shards_for(rows: int, shard: int = SHARD) -> int:
    return max(1, min(LEAST_SHARDS, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / shard))


def fit_cells(rows: DataFrame, sizes: dict[int, int], shard: int, k: int) -> dict[int, Cells]:
    """Cells by vector length, from a sample by the hash of the id that is bounded by SAMPLE and SAMPLE_BYTES."""
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * max(1, *sizes))))
    share = most / sum(sizes.values())
    some = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * share))
    by: dict[int, list] = {}
    for r in some.select("dim", "v").limit(2 * most).collect():
        by.setdefault(r.dim, []).append(r.v)
    return {d: Cells(np.array(by.get(d, []), np.float64).reshape(-1, d), shards_for(n, shard), k) for d, n in sizes.items()}


def _placed(rows: DataFrame, cells: dict[int, Cells], probes: bool) -> DataFrame:
    """``rows`` (vec_id, v, dim) with ``cell``, the nearest one, or with a row for each cell to visit."""
    shipped = rows.sparkSession.sparkContext.broadcast(cells)

    def place(batch):
        out = [[] for _ in range(4)]
        by: dict[int, list[int]] = {}
        for i, d in enumerate(batch.column(2).to_pylist()):
            by.setdefault(d, []).append(i)
        for d, at in by.items():
            part = batch.take(at)
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
            c = shipped.value[d]
            near = c.nearest(v, c.probes if probes else 1)
            again = np.repeat(np.arange(len(at)), near.shape[1])
            for column, values in zip(out, (part.column(0).take(again), part.column(1).take(again), part.column(2).take(again), near.ravel()), strict=True):
                column.append(values)
        return out

    def run(batch):
        import pyarrow as pa

        for part in slices(batch):
            *kept, near = place(part)
            columns = [pa.concat_arrays(c) for c in kept] + [pa.array(np.concatenate(near), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "dim", "cell"])

    return map_batches(rows.select("vec_id", "v", "dim"), run, "vec_id long, v array<double>, dim int, cell int")


def build(rows: DataFrame, cells: dict[int, Cells], shard: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(dim, cell, sub, graph binary), written: the shards of vectors (vec_id, v, dim), and (dim, cell, subs) of each cell."""
    placed = materialize(_placed(rows, cells, False), "placed")
    subs = materialize(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("subs")), "cells")
    keys = ("dim", "cell", "sub")
    dealt = placed.join(F.broadcast(subs), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))
    # More parts than keys, so that few keys share a task; a number that is given isn't lowered at run time.
    dealt = dealt.select("vec_id", "v", *keys).repartition(4 * (subs.agg(F.sum("subs")).first()[0] or 1), *keys)

    def make(key, t):
        import io

        import pyarrow as pa

        d = key[0].as_py()
        v = pa.concat_arrays([c.flatten() for c in t.column("v").chunks]).to_numpy(zero_copy_only=False).reshape(-1, d)
        to = io.BytesIO()
        np.savez(to, **build_shard(t.column("vec_id").to_numpy(), v, k))
        return pa.table({"dim": pa.array([d], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "sub": pa.array([key[2].as_py()], pa.int32()), "graph": pa.array([to.getvalue()], pa.binary())})

    graphs = materialize(dealt.groupBy(*keys).applyInArrow(make, "dim int, cell int, sub int, graph binary"), "graphs")
    discard(placed)
    return graphs, subs


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each row of ``queries``, both as
    (vec_id, embedding).  Only vectors of the same length are compared; ties go to the smaller vec_id; a
    row with the query's vec_id is its own.  Without a usable candidate a query has no rows.  Rows that repeat a
    vec_id give one neighbour, at the nearest of their vectors; empty tables give no rows; other columns are not read."""
    ship_package(vectors.sparkSession)
    small_batches(vectors.sparkSession)
    rows, asked = usable(vectors), usable(queries)
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = fit_cells(rows, sizes, shard, k)
    graphs, subs = build(rows, cells, shard, k)
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    keys = ("dim", "cell", "sub", "block")
    sent = _placed(asked.where(F.col("dim").isin(list(sizes))), cells, True).join(F.broadcast(subs), ["dim", "cell"])
    sent = sent.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    held_ = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = 4 * max(1, graphs.count()) * blocks
    held_, sent = held_.repartition(parts, *keys), sent.select("vec_id", "v", *[F.col(c).alias(c) for c in keys]).repartition(parts, *keys)

    def run(key, g, q):
        import io

        import pyarrow as pa

        out = []
        if g.num_rows and q.num_rows:
            with np.load(io.BytesIO(g.column("graph")[0].as_py())) as stored:
                built = {name: stored[name] for name in stored.files}
            v = pa.concat_arrays([c.flatten() for c in q.column("v").chunks]).to_numpy(zero_copy_only=False).reshape(q.num_rows, -1)
            out = search_built(built, q.column("vec_id").to_numpy(), v, k)
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    each = held_.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = materialize(each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    for done in (graphs, subs):
        discard(done)
    return out


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
