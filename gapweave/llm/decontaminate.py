"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark, normalised, form a hash table that is broadcast while its size
is under a bound.  Every window of every document is looked up by hash and verified as a string;
the hits of a document are merged into hit words.  Beyond the bound only hashes of windows meet, by a
shuffle, and the strings of those found are made from their documents anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import ascii_lower, materialize, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a document that one row holds while its windows are made.
BLOCK = 2048
#: Largest size of the benchmark's windows (characters) that is broadcast.
BROADCAST_CHARS = 16 << 20
#: Parts to which the rows of one window are dealt where the join shuffles.
SALT = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, len, win, h): the windows of n words; an item of fewer, but not none, is one."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w"), F.size(words(F.col("text"))).alias("m")).where("m > 0")
    return (
        w.select(
            "item_id",
            F.least("m", F.lit(n)).alias("len"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.col("m") - n + 1, F.lit(1))),
                    lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "),
                )
            ).alias("win"),
        )
        .distinct()
        .withColumn("h", F.xxhash64("win"))
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, th, n_words, hits array<struct<pos,len>>, items array<item_id>) of every document;
    th is xxhash64(text).  Long documents are cut into blocks that overlap by n - 1 words, so a
    row stays small however long the text is."""
    bench = materialize(benchmark_windows(benchmark, n), "windows")
    size = bench.agg(F.sum(F.length("win") + 32).alias("c"), F.collect_set("len").alias("l")).first()
    lengths = sorted(size["l"] or [])
    base = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    if (size["c"] or 0) <= broadcast_chars:
        windows, bench, keys = every_window(base, lengths, n), F.broadcast(bench), []
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        hashes = bench.select("h", "len").distinct().select("h", "len", parts)
        windows = likely_windows(base, every_window(base, lengths, n, text=False), hashes).withColumn("salt", salt())
        bench, keys = bench.select("*", parts), ["salt"]
    windows = windows.withColumn("h", F.expr("IF(len = 0, xxhash64(doc_id, th), xxhash64(win))"))  # documents are spread if the join shuffles
    keys = ["h", "win", "len", *keys]
    b = bench.select("item_id", *[F.col(c).alias(f"b_{c}") for c in keys])
    hit = windows.join(b, [windows[c] == b[f"b_{c}"] for c in keys], "left").where("b_h IS NOT NULL OR len = 0")
    return hit.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("pos", "len"))).alias("hits"),
        F.collect_set("item_id").alias("items"),
    )


def salt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "th", "pos"), F.lit(SALT)).cast("int")


def every_window(base: DataFrame, lengths: list[int], n: int, text: bool = True) -> DataFrame:
    """(doc_id, th, n_words, pos, len, win) of the windows of the given lengths, and a row of length 0 for each
    document; without ``text`` their hashes h in the place of win, and no such row."""
    blocks = base.select(
        "doc_id",
        "th",
        "n_words",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 1, F.lit(0)), F.lit(BLOCK)),
                lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, F.lit(BLOCK + n - 1)).alias("b")),
            )
        ).alias("k"),
    ).select("doc_id", "th", "n_words", "k.at", "k.b")
    name, of = ("win", "{}") if text else ("h", "xxhash64({})")
    # The row with len 0 stands for the document itself.
    parts = [F.expr("IF(at = 0, array(named_struct('i', -1, 'len', 0, 'win', '')), array())")] if text else []
    for m in lengths:
        last = f"least({BLOCK}, size(b) - {m} + 1)"
        cell = of.format(f"array_join(slice(b, i, {m}), ' ')")
        parts.append(F.expr(f"IF({last} >= 1, transform(sequence(1, {last}), i -> named_struct('i', i, 'len', {m}, '{name}', {cell})), array())"))
    return blocks.select("doc_id", "th", "n_words", "at", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("x")).select(
        "doc_id", "th", "n_words", (F.col("at") + F.col("x.i")).cast("long").alias("pos"), F.col("x.len").alias("len"), F.col(f"x.{name}").alias(name)
    )


def likely_windows(base: DataFrame, hashed: DataFrame, hashes: DataFrame) -> DataFrame:
    """As ``every_window`` gives, of the windows only those with a hash that the benchmark has.

    The windows move as hashes, those of one window dealt to ``SALT`` parts; a document moves once, as words, to
    meet the places found in it."""
    found = hashed.withColumn("salt", salt()).join(hashes, ["h", "len", "salt"], "left_semi")
    found = found.groupBy(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).agg(F.collect_set(F.struct("pos", "len")).alias("at"))
    cells = F.expr(
        "concat(array(named_struct('pos', -1L, 'len', 0, 'win', '')), coalesce(transform(at, x -> named_struct('pos', x.pos, 'len', x.len, 'win', array_join(slice(w, CAST(x.pos AS INT), x.len), ' '))), array()))"
    )
    whole = base.join(found, base["doc_id"].eqNullSafe(found["f_id"]) & (base["th"] == found["f_th"]), "left")
    return whole.select("doc_id", "th", "n_words", F.explode(cells).alias("x")).select("doc_id", "th", "n_words", "x.pos", "x.len", "x.win")


def n_hit(hits: Column) -> Column:
    """Words covered by the windows, each counted once."""
    step = F.expr("struct(CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS c)")
    return F.aggregate(
        F.array_sort(hits),
        step,
        lambda a, x: F.struct(
            F.greatest(a["e"], x["pos"] + x["len"]).alias("e"),
            (a["c"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["e"], x["pos"]))).alias("c"),
        ),
        lambda a: a["c"],
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing.  Rows that repeat doc_id and
    text give one row; other columns are not read.  Over ``broadcast_chars`` characters of windows the join is by
    a shuffle of hashes, with the same result."""
    return find_hits(docs, benchmark, n, broadcast_chars).select(
        "doc_id",
        "n_words",
        n_hit(F.col("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit, all columns kept.  The anti-join takes the keys of the hit
    documents, which are few, and matches null ids too."""
    hit = find_hits(docs, benchmark, n).where(F.size("hits") > 0).select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th"))
    on = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_th"])
    return docs.join(hit, on, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, text): the texts without the words hit, joined by one space; untouched texts stay
    byte for byte."""
    hit = find_hits(docs, benchmark, n).where(F.size("hits") > 0)
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th"), "hits")
    d = docs.select("doc_id", "text")
    cut = F.expr(
        rf"array_join(filter(array_remove(split(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), ''), (x, i) -> NOT exists(hits, s -> i + 1 >= s.pos AND i + 1 < s.pos + s.len)), ' ')"
    )
    return d.join(hit, d["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(d["text"]) == hit["_hit_th"]), "left").select(
        "doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(cut).alias("text")
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
),
h AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.m = dw.m),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
