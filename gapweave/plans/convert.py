"""Format conversions: two to core-allele tables, two to distances."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.variants import genotype_allele
from gapweave.operators import distances
from gapweave.sources import fasta, text


#: Places that meet in one row of the zip.
BLOCK = 4096


def alignment_to_core(spark: SparkSession, positions: str, reference: str, aligned: str) -> DataFrame:
    """Long core alleles of a position list (contig, pos), a reference sequence of those positions and aligned samples, zipped by
    place: (pipeline, chrom, pos 0-based, ref, sample, allele).

    Letters stay as they are; a sample is named by its whole title, records of one title are joined.  Lines of the list under two
    fields or without a position over 0 don't count.  Fails if a sequence has another length than the list.  Each source is a file, or
    a folder whose files in the order of their names are one text.

    The three sources meet by blocks of places, so no row holds a sequence or the list."""
    pos = fasta.numbered(spark, positions, joined=True).withColumn("f", F.split("line", "\t")).where("size(f) >= 2").withColumn("pos", F.get("f", F.lit(1)).try_cast("long")).where("pos >= 1")
    pos = fasta.running(pos, ["unit"], F.lit(1), "i").select("i", F.get("f", F.lit(0)).alias("chrom"), (F.col("pos") - 1).alias("pos"))
    n = pos.count()
    ref = fasta.placed(fasta.chunks(spark, reference, upper=False, joined=True), [])
    samples = fasta.placed(fasta.chunks(spark, aligned, upper=False, joined=True), ["title"])
    sizes = ref.select(F.lit("").alias("title"), "bases").unionByName(samples.select("title", "bases")).groupBy("title").agg(F.sum(F.length("bases")).alias("size"))
    wrong = sizes.where(F.col("size") != n).orderBy("title").first()
    if wrong is not None:
        raise ValueError(f"{wrong.title or 'the reference'} has {wrong['size']} alleles, the list {n} positions")
    places = pos.groupBy(F.expr(f"i div {BLOCK}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("i", "chrom", "pos"))).alias("places"))
    of = lambda d, keys, name: fasta.pieces(d, "start", BLOCK, keys).withColumnRenamed("bases", name)
    rows = of(samples, ["title"], "letters").join(of(ref, [], "ref"), "k").join(places, "k")
    zipped = F.arrays_zip(fasta.letters("letters").alias("a"), fasta.letters("ref").alias("r"), F.col("places").alias("p"))
    out = rows.select("title", F.explode(zipped).alias("x"))
    return out.select(F.lit("").alias("pipeline"), "x.p.chrom", "x.p.pos", F.col("x.r").alias("ref"), F.col("title").alias("sample"), F.col("x.a").alias("allele"))


def _head(spark: SparkSession, path: str) -> list[str]:
    return text.first_line(spark, path).split("\t")


def genotypes_to_core(spark: SparkSession, path: str) -> DataFrame:
    """Long core alleles of a genotype table ``CHROM POS REF ALT TYPE <sample>.GT ...``; fails without six columns."""
    head = _head(spark, path)
    if len(head) < 6:
        raise ValueError(f"{path} needs CHROM, POS, REF, ALT, TYPE and samples")
    names = F.array(*[F.lit(re.sub(r"(\.GT)+$", "", x)) for x in head[5:]])
    t = text._fields(text.lines(spark, path), 6).where(F.col("line") != "\t".join(head))
    f = text._f
    z = F.arrays_zip(names.alias("s"), F.slice("f", F.lit(6), F.size("f")).alias("g"))
    out = t.select(f(0).alias("chrom"), f(1).try_cast("long").alias("p"), f(2).alias("ref"), f(3).alias("alt"), F.explode(z).alias("x")).where("p >= 1 AND x.s IS NOT NULL")
    return out.select(F.lit("").alias("pipeline"), "chrom", (F.col("p") - 1).alias("pos"), "ref", F.col("x.s").alias("sample"), genotype_allele(F.col("x.g"), "ref", "alt").alias("allele"))


def _pairs(alleles: DataFrame) -> DataFrame:
    return distances.hamming(alleles, alleles.select("sample").distinct())


def nexus_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The taxa and the rows (n, cells) of the matrix of a Nexus file with a row for each position.

    The block begins after the first line ``matrix`` and ends before the next that begins with ``;`` or ``end``; what stands before and
    behind it is not read.  Taxa come from the last taxlabels line before the block."""
    rows = fasta.numbered(spark, path, joined=True).select(F.struct("seg", "n").alias("n"), F.trim("line", F.lit(" \t\r")).alias("line"))
    first = lambda found: rows.where(found).agg(F.min("n").alias("n"))
    begin = first(F.col("line") == "matrix")
    if begin.first().n is None:
        raise ValueError(f"{path} has no matrix")
    rows = rows.crossJoin(F.broadcast(begin.withColumnRenamed("n", "_begin")))
    labels = rows.where((F.col("n") < F.col("_begin")) & F.startswith("line", F.lit("taxlabels"))).agg(F.max_by("line", "n")).first()[0] or ""
    names = [x.strip() for x in labels.removeprefix("taxlabels").rstrip(";").split("\t") if x.strip()]
    end = first((F.col("n") > F.col("_begin")) & (F.startswith("line", F.lit(";")) | F.startswith("line", F.lit("end")))).withColumnRenamed("n", "_end")
    body = rows.crossJoin(F.broadcast(end)).where((F.col("n") > F.col("_begin")) & (F.col("_end").isNull() | (F.col("n") < F.col("_end"))))
    body = body.withColumn("f", F.split("line", "\t")).where(F.size("f") > len(names))
    return names, body.select("n", F.slice("f", 2, max(1, len(names))).alias("cells"))


def nexus_to_distances(spark: SparkSession, path: str) -> DataFrame:
    """Pair distances of a Nexus matrix; REF is left out."""
    names, body = nexus_rows(spark, path)
    z = F.arrays_zip(F.array(*[F.lit(x) for x in names]).cast("array<string>").alias("s"), F.col("cells").alias("a"))
    cells = F.transform(F.filter(z, lambda x: x["s"] != "REF"), lambda x: F.struct(x["s"].alias("sample"), F.substring(x["a"], 1, 1).alias("allele")))
    known = spark.createDataFrame([(x,) for x in names if x != "REF"], "sample string")
    return distances.hamming_rows(body.select(cells.alias("cells")), known)


def core_to_distances(spark: SparkSession, path: str) -> DataFrame:
    """Pair distances of a core-allele table; missing cells are N and names stay whole."""
    head = _head(spark, path)
    names = F.array(*[F.lit(x) for x in head[3:]])
    t = text._fields(text.lines(spark, path), 3).where(F.col("line") != "\t".join(head))
    long = t.select(F.col("n").alias("pos"), F.posexplode(names).alias("i", "sample"), "f")
    return _pairs(long.select("pos", "sample", F.coalesce(F.get("f", F.col("i") + 3), F.lit("N")).alias("allele")))


CONVERSIONS = {("alignment", "core"): alignment_to_core, ("genotypes", "core"): genotypes_to_core, ("nexus", "distances"): nexus_to_distances, ("core", "distances"): core_to_distances}


def convert(spark: SparkSession, source: str, target: str, *paths: str) -> DataFrame:
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}; there are {sorted(CONVERSIONS)}")
    return CONVERSIONS[source, target](spark, *paths)
