"""Shared helpers of the training-data operators.

Conventions that hold for every operator here:

* a null text counts as the empty text;
* only the named input columns are read, so extra columns with any name are harmless;
* ``doc_id`` may be null or repeated.  Operators that regroup rows key them by
  ``(doc_id, xxhash64(text))``: rows repeating both give one result row.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def letter_words(text: Column) -> Column:
    """The words of a text, runs of letters in lower case, parted by one space.  Learning and scoring both take
    them from here.  A text without such words comes back as it is."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    return F.when(words.isin("", " "), F.coalesce(text, F.lit(""))).otherwise(words)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  ``spark.checkpoint.dir`` names it on a
    cluster; only a session without that setting (a local test) gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        path = "file://" + tempfile.mkdtemp(prefix="gapweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: it cuts the lineage,
    survives lost executors and lets later plans prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gapweave/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def most_frequent(counts: DataFrame, word: str, count: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the highest counts, or a few less: histograms of ever finer keys (ranges of counts,
    counts, hashes of words) give the part of them that still fits, so only those rows come to the driver."""
    kept, rest = counts.limit(0), counts
    keys = (F.floor(F.log2(count) * 16), F.col(count), F.pmod(F.xxhash64(word), F.lit(4096)))
    for key in keys:
        bins = rest.groupBy(key.cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        bound = None
        for r in sorted(bins, key=lambda r: -r.b):
            if r.n > limit:
                break
            limit -= r.n
            bound = r.b
        crossed = max((r.b for r in bins if bound is None or r.b < bound), default=None)
        if bound is not None:
            kept = kept.unionByName(rest.where(key.cast("long") >= bound))
        if crossed is None:
            break
        rest = rest.where(key.cast("long") == crossed)
    return kept


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once for each context: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gapweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(os.path.dirname(here))
    path = os.path.join(tempfile.mkdtemp(prefix="gapweave-zip-"), "gapweave_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(top, "gapweave", "__init__.py"), "gapweave/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"gapweave/llm/{name}")
    sc.addPyFile(path)
    sc._gapweave_shipped = True


#: Bounds of an Arrow batch; texts and sets may be long, and an executor holds a batch more than once.
BATCH_BYTES, BATCH_ROWS = "4m", "2000"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch bounds where they are still Spark's own."""
    for key, default, value in (("maxBytesPerBatch", "67108864b", BATCH_BYTES), ("maxRecordsPerBatch", "10000", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


#: Rows, and about as many bytes, that a Python operator turns into objects at once.
SLICE, SLICE_BYTES = 256, 1 << 20


_slot: dict = {}


def held(key: str, build):
    """A large object of a worker, such as a model.  A worker holds one: another key drops the one before."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = build()
    return _slot[key]


def _tidy() -> None:
    """Gives freed memory back to the system, so that idle workers stay small."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_batches(df: DataFrame, fn, types, keep: str | None = None) -> DataFrame:
    """Runs ``fn(batch) -> batches`` over Arrow batches; ``keep`` is the key of the held object that it uses."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        from gapweave.llm import common

        if keep not in common._slot:
            common._slot.clear()
        try:
            for batch in batches:
                yield from fn(batch)
        finally:
            common._tidy()

    return df.mapInArrow(run, types)


def slices(batch):
    step = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_rows(df: DataFrame, fn, schema: str, keep: str | None = None) -> DataFrame:
    """Runs ``fn(rows) -> rows`` over lists of at most SLICE row tuples in Arrow batches.  Rows map to
    rows one by one or in bounded numbers, partitions never meet, and memory holds a slice."""
    import pyspark.sql.types as T

    types = T._parse_datatype_string(schema)

    def run(batch):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(types)
        for part in slices(batch):
            rows = fn(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return map_batches(df, run, types, keep)


def change_texts(df: DataFrame, change, keep: str | None = None) -> DataFrame:
    """All rows with ``text`` changed, the other columns as they are."""
    at = df.columns.index("text")

    def run(batch):
        import pyarrow as pa

        for part in slices(batch):
            text = pa.array([change(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return map_batches(df, run, df.schema, keep)
