"""Product codes of vectors, fitted by Lloyd rounds over all rows with exponion search.

Each vector is cut into equal parts, each part position has a codebook of integer entries, and a part's code is the
index of its nearest entry.  A round is one pass of the workers: each part starts at the entry it had before, at
distance u, and only entries within 2u of that entry can be as near, so the list of that entry's neighbours, sorted by
distance, is scanned up to that radius.  Distances are exact integers; ties go to the lower index.  Each pass writes the codes
and, with the first row of each batch, the batch's sums, which the next round adds up in Spark; the driver holds
codebooks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm.common import discard, map_batches, materialize, table

#: Units in 1, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_SUMS = T.ArrayType(T.StructType().add("part", T.IntegerType()).add("entry", T.IntegerType()).add("n", T.LongType()).add("total", T.ArrayType(T.DecimalType(38, 0))))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where they fit, else Python's."""
    y = np.floor(np.asarray(x, np.float64) * scale)
    if np.abs(y).max(initial=0.0) < 2.0**52:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def _wide(v: np.ndarray, book: np.ndarray) -> bool:
    """Whether squared distances may leave 62 bits."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    return (2 * most) ** 2 * max(1, v.shape[1]) >= 1 << 62


def nearest_entries(v: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, found from entry ``start`` of each row."""
    if _wide(v, book):
        v, book = v.astype(object), book.astype(object)
    gap = ((book[:, None] - book[None]) ** 2).sum(2)
    near = np.array([[j for j in np.argsort(g, kind="stable") if j != i] for i, g in enumerate(gap)], np.int64).reshape(len(book), len(book) - 1)
    reach = np.take_along_axis(gap, near, 1)
    best = start.astype(np.int64)
    dist = ((v - book[start]) ** 2).sum(1)
    # An entry nearer than u, or as near, is within 2u of the first; both sides squared.
    inside = (reach[start] <= 4 * dist[:, None]).astype(bool).sum(1)
    for j in range(int(inside.max(initial=0))):
        live = np.flatnonzero(inside > j)
        entry = near[start[live], j]
        d = ((v[live] - book[entry]) ** 2).sum(1)
        better = ((d < dist[live]) | ((d == dist[live]) & (entry < best[live]))).astype(bool)
        best[live[better]], dist[live[better]] = entry[better], d[better]
    return best, dist


def _sums(v: np.ndarray, codes: np.ndarray, entries: int) -> list[tuple[int, int, list[int]]]:
    """(entry, n, componentwise total) of the entries in use."""
    return [(e, int(at.sum()), v[at].sum(0).tolist()) for e in range(entries) if (at := codes == e).any()]


def _pass(rows: DataFrame, books: list[np.ndarray], keep: list[str], sums: bool) -> DataFrame:
    """``rows`` with codes, error and, where asked for, sums."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]
    fields = [rows.schema[c] for c in [*keep, "embedding"]] + [T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("sums", _SUMS)]
    types = T.StructType(fields)

    def run(batch):
        import decimal

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, n = to_arrow_schema(types), batch.num_rows
        names = batch.schema.names
        v = integers(batch.column(names.index("embedding")).flatten().to_numpy(zero_copy_only=False).reshape(n, parts * width), SCALE)
        if "codes" in names:
            old = np.frombuffer(b"".join(batch.column(names.index("codes")).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
        else:
            old = np.zeros((n, parts), np.int64)
        codes, error, told = np.zeros((n, parts), np.uint8), [0] * n, []
        for p, book in enumerate(books):
            x = v[:, p * width : (p + 1) * width]
            best, dist = nearest_entries(x, book, old[:, p])
            codes[:, p] = best
            error = [a + b for a, b in zip(error, dist.tolist(), strict=True)]
            if sums:
                told += [{"part": p, "entry": e, "n": m, "total": [decimal.Decimal(t) for t in total]} for e, m, total in _sums(x, best, entries)]
        made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64()), pa.array([told if sums and i == 0 else None for i in range(n)], out.field("sums").type)]
        kept = [batch.column(names.index(c)).cast(out.field(c).type) for c in [*keep, "embedding"]]
        yield pa.RecordBatch.from_arrays([*kept, *(a.cast(out.field(i + len(kept)).type) for i, a in enumerate(made))], schema=out)

    def whole(batch):
        return run(batch) if batch.num_rows else ()

    return map_batches(rows, whole, types)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows whose vector and components are not null and finite."""
    v = vectors.where("embedding IS NOT NULL")
    if v.schema["embedding"].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        v = v.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return v.where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def compress(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(keep..., codes binary, error long) of the usable rows, and the codebooks, one (entries, width) array for each part.

    Codebooks start as the vectors of the least vec_ids (null ids last, repeated ids in the order of their vectors); fewer rows
    make smaller codebooks.  Rows that repeat each count.  All vectors must have one length, a multiple of ``parts``;
    else a ValueError says so.  Distances are exact at any magnitude; an error or sum beyond 64 or 126 bits raises.  An
    empty table gives no rows and empty codebooks; other columns are not read."""
    rows = usable(vectors).select(*keep, "embedding")
    size = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if size[0] is None:
        return rows.select(*keep, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts
    if size[0] != size[1] or size[0] % parts:
        raise ValueError(f"vectors of {size[0]} to {size[1]} components can't be cut into {parts} equal parts")
    width = size[0] // parts
    first = usable(vectors).select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = integers(np.array([r.embedding for r in first], np.float64).reshape(len(first), size[0]), SCALE)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    state = rows
    for _ in range(rounds):
        done = materialize(_pass(state, books, list(keep), True), "codes")
        if state is not rows:
            discard(state)
        state = done
        s = state.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.part", "s.entry", "s.n", F.posexplode("s.total").alias("at", "x"))
        totals = s.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = [b.astype(object) for b in books]
        for r in totals.collect():  # parts * entries * width rows
            books[r.part][r.entry, r["at"]] = int(r.x) // r.n
        books = [b.astype(np.int64) if max(map(abs, b.ravel().tolist()), default=0) < 1 << 62 else b for b in books]
    last = materialize(_pass(state, books, list(keep), False).drop("sums", "embedding"), "codes")
    if state is not rows:
        discard(state)
    return last, books


def restore(coded: DataFrame, books: list[np.ndarray], keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keep..., embedding array<double>): the entries that the codes name, in the units of the vectors."""
    entry = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in e)) for e in b)) for b in books))
    code = [F.conv(F.substring(F.hex("codes"), 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return coded.select(*keep, F.flatten(F.array(*(entry[p][c] for p, c in enumerate(code)))).alias("embedding"))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def op12_product_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"), keep=("vec_id", "label"))
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by, coded["label"].eqNullSafe(by["_label"])).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    square = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "points AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p))",
        "b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM points WHERE rid <= 16)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min({square.format('points.x', 'b.x')} * 16 + e) AS k FROM points JOIN b{r} AS b USING (p) GROUP BY rid, p)")
        if r < ROUNDS:
            steps.append(
                f"s{r} AS MATERIALIZED (SELECT p, k % 16 AS e, i, sum(x[i]) AS s, count(*) AS n FROM points JOIN a{r} USING (rid, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, k % 16, i)"
            )
            mean = "((s - (((s % n) + n) % n)) / n)::BIGINT"
            steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, list({mean} ORDER BY i) AS y FROM s{r} GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(y, x) AS x FROM b{r} AS b LEFT JOIN m{r} AS m ON m.p = b.p AND m.e = b.e)")
    steps.append(f"coded AS (SELECT rid, string_agg(printf('%02x', (k % 16)::INT), '' ORDER BY p) AS code, sum(k // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)")
    steps.append(f"d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (rid), d"


OP12_SQL = _sql()
