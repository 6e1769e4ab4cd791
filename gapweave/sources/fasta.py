"""FASTA by lines: records may be longer than a row, a split or a task can hold.

Spark reads the lines; a line knows its split and its place in it.  What depends on the lines before (the number of the record, the
offset in it) is a running sum within a split plus the totals of the splits before, so a task holds a split, and one row for each
split meets in one task.  Bases come back in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv

#: Bases of a chunk, about.
CHUNK = 1 << 16


#: The files of a folder that hold sequences.
SUFFIXES = ("fa", "fasta", "fna")
GLOB = "*.{" + ",".join((*SUFFIXES, *(f"{s}.gz" for s in SUFFIXES))) + "}"


def numbered(spark: SparkSession, path, joined: bool = False, glob: str | None = None) -> DataFrame:
    """(unit, seg, n, line): the lines of text files.  Within a unit, a file or with ``joined`` all files of a folder in the order of
    their names, lines are ordered by seg, the split, and n.  Spark numbers the splits of a file in their order."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    t = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    unit = F.regexp_replace("file", "/[^/]*$", "") if joined else F.col("file")
    return t.select(unit.alias("unit"), F.struct("file", F.shiftright("n", 33).alias("split")).alias("seg"), "n", "line")


def running(rows: DataFrame, keys: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of the same keys before a row, in the order of seg and n."""
    sized = rows.withColumn("_size", size.cast("long"))
    within = Window.partitionBy(*keys, "seg").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    own = sized.withColumn("_own", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    totals = sized.groupBy(*keys, "seg").agg(F.sum("_size").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "seg", F.coalesce(before, F.lit(0)).alias("_before"))
    return own.join(totals, [*keys, "seg"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_size", "_own", "_before")


def sample_of(unit: Column) -> Column:
    """The last part of a path without .gz and .fa, .fasta or .fna."""
    name = F.element_at(F.split(unit, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.(fa|fasta|fna)$", "")


def chunks(spark: SparkSession, path, upper: bool = True, joined: bool = False, glob: str | None = None) -> DataFrame:
    """(unit, sample, contig, title, contig_idx, at, bases): the records of FASTA files in chunks, ``at`` from 0 within a record, whose
    chunks are without gaps.  A record without bases has one empty chunk; lines before the first record are left out."""
    rows = numbered(spark, path, joined, glob)
    head = F.startswith("line", F.lit(">"))
    rows = running(rows, ["unit"], head.cast("int"), "heads").withColumn("rec", F.col("heads") + head.cast("int"))
    names = rows.where(head).select("unit", "rec", F.trim(F.substring("line", 2, 1 << 30)).alias("title"))
    body = rows.where(~head & (F.col("rec") > 0)).withColumn("b", F.regexp_replace("line", r"\s", ""))
    body = running(body.select("unit", "seg", "n", "rec", "b"), ["unit", "rec"], F.length("b"), "at").where("b != ''")
    joint = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]), "")
    body = body.groupBy("unit", "rec", F.expr(f"at div {CHUNK}").alias("c")).agg(F.min("at").alias("at"), joint.alias("bases"))
    out = names.join(body, ["unit", "rec"], "left")
    bases = F.coalesce("bases", F.lit(""))
    return out.select(
        "unit", sample_of(F.col("unit")).alias("sample"), F.element_at(F.split("title", r"\s+"), 1).alias("contig"), "title", (F.col("rec") - 1).cast("int").alias("contig_idx"),
        F.coalesce("at", F.lit(0)).cast("long").alias("at"), (F.upper(bases) if upper else bases).alias("bases"),
    )


def folder(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """Chunks of the sequence files of a folder, plain or compressed; a sample for each file, other files are left out."""
    return chunks(spark, path, upper, glob=GLOB)


def contigs(parts: DataFrame) -> DataFrame:
    """(sample, contig, contig_idx, length) of chunks."""
    return parts.groupBy("sample", "contig", "contig_idx").agg(F.sum(F.length("bases")).cast("long").alias("length"))


def cut(records: DataFrame) -> DataFrame:
    """Chunks (sample, contig, contig_idx, at, bases) of records (..., sequence)."""
    at = F.explode(F.expr(f"sequence(0L, greatest(length(sequence) - 1, 0), {CHUNK}L)"))
    return records.withColumn("at", at).withColumn("bases", F.expr(f"substr(sequence, CAST(at AS INT) + 1, {CHUNK})")).drop("sequence")


def placed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with ``start``, their place in the concatenation of the records of the same keys."""
    size = parts.groupBy(*keys, "contig_idx").agg(F.sum(F.length("bases")).alias("length"))
    w = Window.partitionBy(*keys).orderBy("contig_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select(*keys, "contig_idx", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("before"))
    return parts.join(before, [*keys, "contig_idx"]).withColumn("start", F.col("before") + F.col("at")).drop("before")


def pieces(parts: DataFrame, start: str, width: int, keys: list[str]) -> DataFrame:
    """(keys, k, bases): the letters again, cut at the multiples of ``width``."""
    n = F.length("bases")
    each = parts.where(n > 0).withColumn("k", F.explode(F.expr(f"sequence({start} div {width}, ({start} + length(bases) - 1) div {width})")))
    from_ = F.greatest(F.col("k") * width - F.col(start), F.lit(0))
    to = F.least((F.col("k") + 1) * width - F.col(start), n.cast("long"))
    each = each.select(*keys, "k", F.col(start).alias("_s"), F.substring("bases", (from_ + 1).cast("int"), (to - from_).cast("int")).alias("b"))
    return each.groupBy(*keys, "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "b"))), lambda x: x["b"]), "").alias("bases"))


def letters(column: str) -> Column:
    return F.filter(F.split(column, ""), lambda x: x != "")


def unpacked(parts: DataFrame) -> DataFrame:
    """(pos, base) of chunks (start, bases), letters as they are.  Spark takes the size of the packed text for that of the rows, a
    hundredth of what they need in a hash table, so a hint keeps joins from broadcasting them through the driver."""
    rows = parts.select("start", F.posexplode(letters("bases")).alias("i", "base"))
    return rows.select((F.col("start") + F.col("i")).alias("pos"), "base").hint("merge")


def base_rows(parts: DataFrame) -> DataFrame:
    """(pos, base) over the concatenation, upper-cased."""
    return unpacked(placed(parts, [])).withColumn("base", F.upper("base"))


def masked_positions(parts: DataFrame) -> DataFrame:
    """(sample, pos) 0-based of N over the concatenation of each sample."""
    c = placed(parts, ["sample"]).where("contains(upper(bases), 'N')")
    return c.select("sample", "start", F.posexplode(letters("bases")).alias("i", "b")).where("upper(b) = 'N'").select("sample", (F.col("start") + F.col("i")).alias("pos"))


def masked_gaps(parts: DataFrame) -> DataFrame:
    """(sample, start, end) 1-based half-open runs of N."""
    return iv.regions(masked_positions(parts).withColumn("pos", F.col("pos") + 1), ["sample"])


def lines(parts: DataFrame, name: str, width: int = 60) -> DataFrame:
    """(contig_idx, line, value) the lines of one record of all chunks' letters: each contig is wrapped on its own, by position."""
    body = pieces(parts, "at", width, ["contig_idx"]).select(F.col("contig_idx").cast("long").alias("contig_idx"), F.col("k").alias("line"), F.col("bases").alias("value"))
    head = parts.sparkSession.createDataFrame([(-1, 0, f">{name}")], "contig_idx long, line long, value string")
    return head.unionByName(body)


def write(parts: DataFrame, name: str, path: str, width: int = 60) -> None:
    """Writes that record as a folder of text files, in order by their names; ``chunks`` reads it with ``joined``."""
    order = ("contig_idx", "line")
    lines(parts, name, width).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def index(parts: DataFrame, name: str, width: int = 60) -> DataFrame:
    """(value) the index line of that record: name, length, offset of the first base, bases and bytes of a line."""
    n = F.coalesce(F.sum(F.length("bases")), F.lit(0)).cast("string")
    return parts.agg(n.alias("n")).select(F.concat_ws("\t", F.lit(name), "n", F.lit(str(len(name) + 2)), F.lit(str(width)), F.lit(str(width + 1))).alias("value"))


def aligned_files(spark: SparkSession, folder: str, samples: DataFrame, reference: str | None = None) -> DataFrame:
    """(sample, path): of each sample the aligned sequence in a folder of result folders.

    Result folders are taken in this order: <sample>_snippy_<reference>ref, <sample>_snippy, <sample>; in the first that
    there is, <sample>_snippy.aligned.fa, <sample>.aligned.fa or snps.aligned.fa.  Only names are read."""
    from gapweave.operators.callsets import rank_by_priority

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z0-9]+:/*", "")), f"/{root}/", -1)
    found = found.withColumn("p", F.split(below, "/")).where("size(p) = 2").select("path", F.get("p", F.lit(0)).alias("dir"), F.get("p", F.lit(1)).alias("name"))
    s = F.col("sample")
    dirs = [F.concat(s, F.lit("_snippy")), s]
    if reference is not None:
        dirs.insert(0, F.concat(s, F.lit(f"_snippy_{reference}ref")))
    named = samples.select("sample", F.posexplode(F.array(*dirs)).alias("rank", "dir")).join(found, "dir")
    first = rank_by_priority(named.select("sample", "rank", "dir").distinct(), ["sample"], "rank")
    files = F.array(F.concat(s, F.lit("_snippy.aligned.fa")), F.concat(s, F.lit(".aligned.fa")), F.lit("snps.aligned.fa"))
    ranked = first.join(found, "dir").withColumn("rank", F.array_position(files, F.col("name"))).where("rank > 0")
    return rank_by_priority(ranked, ["sample"], "rank").select("sample", "path")


def aligned_gaps(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(sample, start, end) 1-based half-open runs of N in the aligned sequences of (sample, path); a file for each sample."""
    paths = [r.path for r in files.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "sample string, start long, end long")
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    parts = chunks(spark, paths).drop("sample").withColumn("_p", bare("unit"))
    return masked_gaps(parts.join(files.select("sample", bare("path").alias("_p")), "_p"))
