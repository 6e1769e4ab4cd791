"""Language identification by word-first backoff.

A word known to the model counts with its log frequency in each language.  An unseen word falls
back to its character n-grams, from the longest down to the first length of which one is known.
"""

from __future__ import annotations

import math
import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import discard, held, letter_words, map_batches, map_rows, materialize, shared_dir, ship_package, slices, table

#: Longest n-gram; words get a mark at both ends.
LONGEST = 5
#: Pseudo-count of a word or n-gram in each language, and least count of a known one.
PRIOR, LEAST = 0.5, 3
#: Words, and n-grams, that a worker remembers before it starts anew.
CACHE, CACHE_GRAMS = 150_000, 60_000
#: Entries of a file of the model; a task holds the entries of one.
FILE_ROWS = 250_000
UND = "und"
#: Characters of a word whose n-grams are made at once, so one long word fills no row and no list.
STRETCH = 1024


def learn(docs: DataFrame) -> dict:
    """The model of documents (text, lang), rows without either left out: languages, and the folders of
    log frequencies of words and n-grams less their mean over the languages.  Every word and n-gram of
    count LEAST or more is kept.

    Words are counted per task before they are shuffled; n-grams are taken from the distinct words.
    Executors write the entries, so the driver's memory holds none.  Where the shared folder is mounted, workers map
    the files in it; else Spark ships the files to each machine that asks for them, the driver's too."""
    w = (
        docs.where("text IS NOT NULL AND lang IS NOT NULL")
        .select("lang", F.explode(F.split(letter_words(F.col("text")), " ")).alias("w"))
        .where(r"w RLIKE '^\\p{L}+$'")
        .groupBy("lang", "w")
        .agg(F.count(F.lit(1)).alias("c"))
        .cache()
    )
    totals = {r.lang: r.c for r in w.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    langs = sorted(totals)
    if not langs:
        w.unpersist()
        return {"langs": [], "prior": [], "words": None, "grams": None}
    g = (
        w.select("lang", "c", F.concat(F.lit("^"), "w", F.lit("$")).alias("p"))
        .select("lang", "c", F.explode(F.expr(f"transform(sequence(1, length(p), {STRETCH}), a -> substr(p, a, {STRETCH + LONGEST - 1}))")).alias("p"))
        .select(
            "lang",
            "c",
            F.explode(
                F.expr(
                    f"flatten(transform(sequence(1, {LONGEST}), n -> IF(length(p) >= n, transform(sequence(1, least(length(p) - n + 1, {STRETCH})), i -> substr(p, i, n)), array())))"
                )
            ).alias("w"),
        )
        .groupBy("lang", "w")
        .agg(F.sum("c").alias("c"))
    )
    out = {"langs": langs, "prior": [float(np.log(totals[x] / sum(totals.values()))) for x in langs], "words": write_entries(w, langs), "grams": write_entries(g, langs)}
    w.unpersist()
    return out


def write_entries(counts: DataFrame, langs: list[str]) -> tuple[str, int, bool]:
    """(folder, number of files, shipped) of the entries of (lang, w, c): w and a float32 for each language, dealt
    to files by the hash of w and sorted by it."""
    spark = counts.sparkSession
    where = urlparse(shared_dir(spark))
    mounted = where.scheme in ("", "file")
    folder = f"{where.path}/gapweave/model-{uuid.uuid4().hex}"
    names = [f"c{i}" for i in range(len(langs))]
    by = [F.sum(F.when(F.col("lang") == x, F.col("c")).otherwise(0)).alias(c) for x, c in zip(langs, names, strict=True)]
    known = materialize(counts.groupBy("w").agg(F.sum("c").alias("all"), *by).where(F.col("all") >= LEAST).drop("all"), "counts")
    n, *sums = known.agg(F.count(F.lit(1)), *[F.sum(c) for c in names]).first()
    files = max(1, math.ceil(n / FILE_ROWS))
    if n:
        whole = np.array(sums, np.float64) + PRIOR * n
        ship_package(spark)

        def write(key, part):
            import pyarrow as pa

            words = part["w"].to_pylist()
            h = np.array([hash_word(w) for w in words], np.uint64)
            p = np.log((np.column_stack([part[c].to_numpy() for c in names]) + PRIOR) / whole)
            order = np.argsort(h, kind="stable")
            rows = (p - p.mean(1, keepdims=True)).astype(np.float32)[order]
            out = pa.table({"h": h[order], "w": part["w"].combine_chunks().take(pa.array(order)), "row": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(names))})
            to = pa.BufferOutputStream()
            with pa.ipc.new_file(to, out.schema) as f:
                f.write_table(out)
            packed = to.getvalue().to_pybytes()
            if mounted:
                put(f"{folder}/{key[0].as_py()}.arrow", packed)
                packed = None
            return pa.table({"file": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(words)], pa.int64()), "packed": pa.array([packed], pa.binary())})

        dealt = known.withColumn("file", F.pmod(F.xxhash64("w"), F.lit(files)).cast("int"))
        sent = dealt.groupBy("file").applyInArrow(write, "file int, n long, packed binary")
        if not mounted:
            sent = materialize(sent, "model")
            path = sent.inputFiles()[0].rsplit("/", 1)[0]
            spark.sparkContext.addFile(path, recursive=True)
            folder = path.rsplit("/", 1)[1]
        wrote = sent.agg(F.sum("n")).first()[0]
        if wrote != n:
            raise RuntimeError(f"{wrote} of {n} entries written")
    discard(known)
    return folder, files, bool(n) and not mounted


def put(path: str, content) -> None:
    """Writes a file at once: others see it whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(content)
    os.replace(aside, path)


def unpacked(name: str) -> str:
    """The folder of files that Spark shipped to this machine, unpacked by the first worker that asks."""
    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    folder = SparkFiles.get(name)
    for part in sorted(p for p in os.listdir(folder) if p.endswith(".parquet")):
        source = pq.ParquetFile(f"{folder}/{part}")
        if all(os.path.exists(f"{folder}/{i}.arrow") for i in source.read(["file"])["file"].to_pylist()):
            continue
        for batch in source.iter_batches(batch_size=1):
            put(f"{folder}/{batch['file'][0].as_py()}.arrow", batch["packed"][0].as_buffer())
    return folder


def hash_word(word: str) -> int:
    """xxhash64 of Spark SQL as an unsigned number."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


class Entries:
    """Looks words up in the mapped files of a folder."""

    def __init__(self, folder: str, files: int, shipped: bool, k: int):
        import pyarrow as pa

        if shipped:
            folder = unpacked(folder)
        self.files, self.k, self.parts = files, k, {}
        for i in range(files):
            if os.path.exists(path := f"{folder}/{i}.arrow"):
                t = pa.ipc.open_file(pa.memory_map(path)).read_all().combine_chunks()
                h, w, row = (t[c].chunk(0) for c in ("h", "w", "row"))
                self.parts[i] = h.to_numpy(), w, row.flatten().to_numpy().reshape(-1, k)

    def get(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(known, rows): whether each word is there, and its row, zeros where not."""
        import pyarrow as pa
        import pyarrow.compute as pc

        known, rows = np.zeros(len(words), bool), np.zeros((len(words), self.k), np.float32)
        h = np.array([hash_word(w) for w in words], np.uint64)
        file = h.view(np.int64) % self.files
        for f in np.unique(file):
            if f not in self.parts:
                continue
            hashes, names, cells = self.parts[f]
            asked = np.flatnonzero(file == f)
            at = np.searchsorted(hashes, h[asked])
            while len(asked):  # on from one entry to the next with the same hash
                ok = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h[asked])
                asked, at = asked[ok], at[ok]
                same = pc.equal(names.take(pa.array(at)), pa.array([words[i] for i in asked.tolist()], names.type)).to_numpy(zero_copy_only=False)
                known[asked[same]], rows[asked[same]] = True, cells[at[same]]
                asked, at = asked[~same], at[~same] + 1
        return known, rows


class Scorer:
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.prior = np.array(model["prior"])
        k = max(1, len(self.langs))
        if self.langs:
            self.words, self.grams = Entries(*model["words"], k), Entries(*model["grams"], k)
        self.rows = np.zeros((CACHE, k), np.float32)
        self.ids: dict[str, int] = {}
        self.met: dict[str, np.ndarray | None] = {}

    def meet(self, grams) -> None:
        new = [g for g in dict.fromkeys(grams) if g not in self.met]
        known, rows = self.grams.get(new)
        self.met.update((g, rows[i].copy() if known[i] else None) for i, g in enumerate(new))

    def unseen(self, words: list[str]) -> list[np.ndarray]:
        out = [np.zeros(self.rows.shape[1], np.float32)] * len(words)
        left = {i: f"^{w}$" for i, w in enumerate(words)}
        for i in [i for i, p in left.items() if len(p) > STRETCH]:
            out[i] = self.unseen_long(left.pop(i))
        for n in range(LONGEST, 0, -1):
            own = {i: [p[a : a + n] for a in range(len(p) - n + 1)] for i, p in left.items()}
            if len(self.met) > CACHE_GRAMS:
                self.met = {}
            self.meet(g for gs in own.values() for g in gs)
            for i, gs in own.items():
                found = [r for g in gs if (r := self.met[g]) is not None]
                if found:
                    out[i] = np.array(found).mean(0)
                    del left[i]
        return out

    def unseen_long(self, p: str) -> np.ndarray:
        """The same for one long word, a stretch at a time."""
        for n in range(LONGEST, 0, -1):
            total, count = np.zeros(self.rows.shape[1]), 0
            for at in range(0, len(p) - n + 1, STRETCH):
                if len(self.met) > CACHE_GRAMS:
                    self.met = {}
                own = [p[a : a + n] for a in range(at, min(at + STRETCH, len(p) - n + 1))]
                self.meet(own)
                found = [r for g in own if (r := self.met[g]) is not None]
                if found:
                    total += np.array(found).sum(0, dtype=np.float64)
                    count += len(found)
            if count:
                return (total / count).astype(np.float32)
        return np.zeros(self.rows.shape[1], np.float32)

    def fetch(self, lists: list[list[str]]) -> None:
        """Puts the words of the lists into the cache."""
        words = set().union(*lists)
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > len(self.rows):
            self.ids, new = {}, words
            self.rows = np.zeros((max(CACHE, len(new)), self.rows.shape[1]), np.float32)
        if not new:
            return
        new = list(new)
        known, rows = self.words.get(new)
        other = np.nonzero(~known)[0].tolist()
        for i, row in zip(other, self.unseen([new[i] for i in other]), strict=True):
            rows[i] = row
        at = len(self.ids)
        self.rows[at : at + len(new)] = rows
        self.ids.update((w, at + i) for i, w in enumerate(new))

    def split(self, text: str) -> list[str]:
        """The words of what ``letter_words`` gives.  Without any, letters too new for it still count."""
        words = text.split()
        return words if not words or words[0].isalpha() else [w for w in words if any(map(str.isalpha, w))]

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of texts that went through ``letter_words``."""
        lists = [self.split(t) if self.langs else [] for t in texts]
        self.fetch(lists)
        return [self.one(ws) if ws else (UND, 0.0) for ws in lists]

    def one(self, words: list[str]) -> tuple[str, float]:
        total = self.prior.copy()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            total += self.rows.take(np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part)), 0).sum(0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred and score (0 to 1) of each row; no row moves.

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing was learned.
    Equal totals go to the language that is first by name.  Texts and words count whole, however long; a row
    that repeats gives a row each, an empty table none."""
    key = uuid.uuid4().hex
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        scorer = held(key, lambda: Scorer(shipped.value))
        return [(*r[:-1], *s) for r, s in zip(batch, scorer.score([r[-1] for r in batch]), strict=True)]

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return map_rows(docs.select(*carry, letter_words(F.col("text"))), rows, ", ".join([*fields, "lang_pred string", "score double"]), key)


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.select("text", "lang", fold(F.col("doc_id"), 4).alias("k")).where("k != 2")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least the given score; columns as in ``docs``, repeated
    rows each.  Null texts and those without a letter go.

    The label column ``lang`` is learned from, not used to score."""
    model = learn(learning_rows(docs))
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        import pyarrow as pa

        scorer = held(key, lambda: Scorer(shipped.value))
        for part in slices(batch):
            found = scorer.score(part.column(part.num_columns - 1).to_pylist())
            keep = pa.array([lang != UND and score >= least for lang, score in found], pa.bool_())
            own = pa.schema([part.schema.field(i) for i in range(part.num_columns - 1)])
            yield pa.RecordBatch.from_arrays(part.columns[:-1], schema=own).filter(keep)

    return map_batches(docs.select("*", letter_words(F.col("text"))), run, docs.schema, key)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(learning_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
