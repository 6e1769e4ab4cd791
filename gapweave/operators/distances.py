"""SNP distances between samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.variants import valid_base
from gapweave.operators.callsets import validate


def hamming(alleles: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, b, distance) of every pair a < b over a long table (pos, sample, allele): positions at which both have
    one of A, C, G, T and they differ.

    A position is paired by its groups of equal bases, so what most samples share costs nothing: only
    pairs of different bases are made."""
    ok = alleles.where(valid_base("allele"))
    left = ok.select("pos", F.col("sample").alias("x"), F.col("allele").alias("xa"))
    groups = ok.groupBy("pos", "allele").agg(F.collect_set("sample").alias("s"))
    return _counted(left.join(groups, "pos").where("xa < allele").select("x", F.explode("s").alias("y")), samples)


def hamming_rows(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """``hamming`` of a table with a row for each position, whose ``cells`` (array<struct<sample, allele>>) are all of it: pairs are
    made within a row, nothing but their counts is shuffled."""
    of = lambda base: F.transform(F.filter("cells", lambda c: c["allele"] == base), lambda c: c["sample"])
    each = F.array(*[F.struct(of(x).alias("xs"), F.array_distinct(of(y)).alias("ys")) for x, y in combinations("ACGT", 2)])
    pairs = rows.select(F.inline(F.filter(each, lambda p: (F.size(p["xs"]) > 0) & (F.size(p["ys"]) > 0)))).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    return _counted(pairs, samples)


def _counted(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    d = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("distance"))
    grid = samples.select(F.col("sample").alias("a")).crossJoin(samples.select(F.col("sample").alias("b"))).where("a < b")
    return grid.join(d, ["a", "b"], "left").select("a", "b", F.coalesce("distance", F.lit(0)).cast("long").alias("distance"))


def comparable(alleles: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, b, comparable): positions at which both samples have a base."""
    ok = alleles.where(valid_base("allele")).groupBy("pos").agg(F.sort_array(F.collect_set("sample")).alias("s"))
    pairs = ok.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    grid = samples.select(F.col("sample").alias("a")).crossJoin(samples.select(F.col("sample").alias("b"))).where("a < b")
    return grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("comparable"))


def validated(observed: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, b, distance) over consensus bases (sample, chrom, pos, base), only at positions that two samples or more have and
    that are no artifact."""
    real = validate(observed).where("verdict = 'real' AND samples >= 2").select("chrom", "pos")
    kept = observed.join(real, ["chrom", "pos"], "left_semi")
    return hamming(kept.select(F.struct("chrom", "pos").alias("pos"), "sample", F.col("base").alias("allele")), samples)


#: What stands for a sample without a call: the reference base, the base of the reads, or reads alone for every sample.
MODES = ("vcf_ref", "vcf_bam", "bam_only")


def filled(calls: DataFrame, bases: DataFrame, ref_base: DataFrame, samples: DataFrame, mode: str, min_depth: int = 0, min_consensus: float = 0.0, min_qual: float = 0.0) -> DataFrame:
    """(a, b, distance, comparable) at the polymorphic sites of ``calls`` (sample, pos, alt, qual, dp), those with an alt
    unlike the reference.  A call under ``min_qual`` or ``min_depth`` is no base at all; of ``bases`` (sample, pos, base, depth,
    consensus in percent) those under ``min_depth`` or ``min_consensus`` don't count.

    With ``vcf_ref`` samples without a call are never listed: carriers meet carriers and failed calls only."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    called = calls.join(ref_base, "pos").where("alt != base").select("sample", "pos", "alt", ((F.col("qual") >= min_qual) & (F.col("dp") >= min_depth)).alias("ok"))
    if mode == "vcf_ref":
        return _against_reference(called, samples)
    read = bases.where((F.col("depth") >= min_depth) & (F.col("consensus") >= min_consensus)).join(called.select("pos").distinct(), "pos", "left_semi").select("sample", "pos", F.col("base").alias("allele"))
    if mode == "vcf_bam":
        read = read.join(called, ["sample", "pos"], "left_anti").unionByName(called.where("ok").select("sample", "pos", F.col("alt").alias("allele")))
    return hamming(read, samples).join(comparable(read, samples), ["a", "b"])


def _against_reference(called: DataFrame, samples: DataFrame) -> DataFrame:
    one = lambda name, x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
    own = called.groupBy("sample").agg(one("alts", F.col("ok")), one("lost", ~F.col("ok")))
    site = called.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("sample", "alt", "ok"))).alias("c"))
    rest = F.slice("c", F.col("i") + 2, F.size("c"))
    met = site.select("c", F.posexplode("c").alias("i", "x")).select("x", F.explode(rest).alias("y"))
    x, y = F.col("x.ok"), F.col("y.ok")
    # Of two alts one site counts once or not at all instead of twice, beside a failed call not at all instead of once.
    excess = F.when(x & y, F.when(F.col("x.alt") == F.col("y.alt"), 2).otherwise(1)).when(x | y, 1).otherwise(0)
    met = met.groupBy(F.col("x.sample").alias("a"), F.col("y.sample").alias("b")).agg(F.sum(excess).alias("excess"), F.count_if(~x & ~y).alias("both_lost"))
    each = samples.select("sample").join(own, "sample", "left").na.fill(0, ["alts", "lost"])
    side = lambda s: each.select(F.col("sample").alias(s), F.col("alts").alias(f"alts_{s}"), F.col("lost").alias(f"lost_{s}"))
    grid = side("a").crossJoin(side("b")).where("a < b").join(met, ["a", "b"], "left").na.fill(0, ["excess", "both_lost"])
    grid = grid.crossJoin(F.broadcast(site.agg(F.count(F.lit(1)).alias("sites"))))
    return grid.select("a", "b", (F.col("alts_a") + F.col("alts_b") - F.col("excess")).alias("distance"), (F.col("sites") - F.col("lost_a") - F.col("lost_b") + F.col("both_lost")).alias("comparable"))


def square(pairs: DataFrame, samples: DataFrame, value: str = "distance") -> DataFrame:
    """Long (row, col, value) of the full symmetric matrix with a zero diagonal."""
    both = pairs.select(F.col("a").alias("row"), F.col("b").alias("col"), value).union(pairs.select("b", "a", value))
    return both.union(samples.select("sample", "sample", F.lit(0).cast("long")))


def wide(matrix: DataFrame, names: list[str], value: str = "distance") -> DataFrame:
    """One column per sample, for files."""
    return matrix.groupBy("row").pivot("col", names).agg(F.first(value)).orderBy("row")
