"""Comparison of two call sets, sample by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.sources.store import stored

KEYS = ["sample", "chrom", "pos"]


def positions(a: DataFrame, b: DataFrame, gaps: DataFrame | None, name_a: str, name_b: str, hints: dict[str, str] | None = None) -> DataFrame:
    """Full outer comparison of passed SNPs (sample, chrom, pos, alt, qual, depth, af) over the samples that both
    have: status, both sides' alt, qual and depth, in_gap (ends inclusive) and likely_cause.

    ``hints`` maps part of a pipeline's name to what to say of an unexplained miss in it."""
    common = a.select("sample").distinct().join(b.select("sample").distinct(), "sample")
    side = lambda d, p: d.join(common, "sample", "left_semi").select(*KEYS, F.col("alt").alias(f"{p}_alt"), F.col("qual").alias(f"{p}_qual"), F.col("depth").alias(f"{p}_depth"), F.col("af").alias(f"{p}_af"))
    j = side(a, "a").join(side(b, "b"), KEYS, "full_outer")
    status = F.when(F.col("a_alt").isNull(), "OnlyPipelineB").when(F.col("b_alt").isNull(), "OnlyPipelineA").when(F.col("a_alt") == F.col("b_alt"), "Concordant").otherwise("DiscordantAllele")
    j = j.withColumn("status", status)
    if gaps is None:
        j = j.withColumn("in_gap", F.lit(False))
    else:
        j = iv.locate(j, iv.closed(gaps, ["sample"]), ["sample"], []).withColumnRenamed("inside", "in_gap")
    only_a = F.col("status") == "OnlyPipelineA"
    one = lambda c: F.when(only_a, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("in_gap"), "In gap region (low coverage)"), F.when(one("depth") < 10, "Low read depth (<10)"), F.when(one("qual") < 100, "Low quality score (<100)"), F.when(one("af") < 0.9, "Allele frequency <90%")
        )
    )
    said = F.lit("Pipeline-specific filter or algorithm difference")
    for part, text in (hints or {}).items():
        missing = F.when(only_a, F.lit(name_b.lower())).otherwise(F.lit(name_a.lower()))
        said = F.when(F.contains(missing, F.lit(part.lower())), text).otherwise(said)
    cause = F.when(F.col("status") == "Concordant", F.lit(None).cast("string")).when(F.col("status") == "DiscordantAllele", "Different alleles called").otherwise(F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(said))
    return j.withColumn("likely_cause", cause)


def per_sample(pos: DataFrame) -> DataFrame:
    """(sample, snps_a, snps_b, concordant, only_a, only_b, discordant_allele, concordance_rate): the rate is over
    the union of positions."""
    s = F.col("status")
    out = pos.groupBy("sample").agg(
        F.count("a_alt").alias("snps_a"), F.count("b_alt").alias("snps_b"), F.count_if(s == "Concordant").alias("concordant"), F.count_if(s == "OnlyPipelineA").alias("only_a"),
        F.count_if(s == "OnlyPipelineB").alias("only_b"), F.count_if(s == "DiscordantAllele").alias("discordant_allele"), F.count(F.lit(1)).alias("_n"),
        F.count_if((s == "OnlyPipelineA") & F.col("in_gap")).alias("a_only_in_gaps"), F.count_if((s == "OnlyPipelineB") & F.col("in_gap")).alias("b_only_in_gaps"),
    )
    return out.withColumn("concordance_rate", F.col("concordant") / F.col("_n") * 100).drop("_n")


def totals(samples: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """One row: total_positions is the sum of the larger call count of each sample, and the rate is over
    it; discordant_allele stays 0 as in the summary this answers to."""
    t = samples.agg(
        F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.sum(F.greatest("snps_a", "snps_b")), F.lit(0)).alias("total_positions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("concordant", "only_a", "only_b", "a_only_in_gaps", "b_only_in_gaps")], F.lit(0).cast("long").alias("discordant_allele"),
    )
    t = t.withColumn("concordance_rate", F.when(F.col("total_positions") > 0, F.col("concordant") / F.col("total_positions") * 100).otherwise(0.0))
    return t.withColumn("interpretation", interpretation(name_a, name_b))


def interpretation(name_a: str, name_b: str):
    """The agreement in words: over concordant and one-sided calls."""
    n = F.col("concordant") + F.col("only_a") + F.col("only_b")
    p = F.col("concordant") / n * 100
    band = (
        F.when(p > 95, F.format_string("Excellent agreement (%.1f%% concordance)", p))
        .when(p > 80, F.format_string("Good agreement (%.1f%% concordance)", p))
        .when(p > 50, F.format_string("Moderate agreement (%.1f%% concordance) - review discordant positions", p))
        .otherwise(F.format_string("Poor agreement (%.1f%% concordance) - significant pipeline differences", p))
    )

    def more(x, y, nx, ny):
        return F.format_string(f". {nx} found %dx more unique SNPs than {ny} - possible {ny} sensitivity issue", F.floor(F.col(x) / F.greatest(y, F.lit(1))))

    sens = F.when(F.col("only_a") > F.col("only_b") * 2, more("only_a", "only_b", name_a, name_b)).when(F.col("only_b") > F.col("only_a") * 2, more("only_b", "only_a", name_b, name_a)).otherwise("")
    gap = F.when((F.col("a_only_in_gaps") > 0) | (F.col("b_only_in_gaps") > 0), F.format_string(f". %d SNPs unique to {name_a} and %d unique to {name_b} are in low-coverage regions", "a_only_in_gaps", "b_only_in_gaps")).otherwise("")
    return F.when(n == 0, "No variants to compare").otherwise(F.concat(band, sens, gap))


def top_missed(pos: DataFrame, side: str, limit: int = 50) -> DataFrame:
    """The calls of one side (a or b) that the other lacks, quality over 100 and depth over 10, best quality
    first; ties by sample, chrom, pos."""
    mine = pos.where(F.col("status") == ("OnlyPipelineA" if side == "a" else "OnlyPipelineB")).where((F.col(f"{side}_qual") > 100) & (F.col(f"{side}_depth") > 10))
    return mine.orderBy(F.desc(f"{side}_qual"), *KEYS).limit(limit)


def page(pos: DataFrame, number: int, size: int, sample: str = "all", status: str = "all") -> DataFrame:
    """Page ``number`` (from 0) of the positions in the order of sample, chrom and pos, with the number of
    matching rows and of pages."""
    if size < 1:
        raise ValueError("the page size must be positive")
    rows = pos
    if sample != "all":
        rows = rows.where(F.col("sample") == sample)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return rows.orderBy(*KEYS).offset(number * size).limit(size).crossJoin(F.broadcast(total))


def pages(rows: DataFrame, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """The rows with ``place`` (from 0) in the order of (column, ascending) pairs, and ``page``; nulls come last.

    The rows are written once, dealt to ranges of the order and sorted within each; a place is that in the range plus the sizes
    of the ranges before, so no task sorts the whole table and any page is a filter.  Name enough columns to make the order
    definite."""
    if size < 1:
        raise ValueError("the page size must be positive")
    by = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = stored(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "pages")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = kept.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("place", F.col("_before") + F.col("_n"))
    return out.withColumn("page", F.expr(f"place div {size}")).drop("_part", "_n", "_before")


def after(rows: DataFrame, order: list[tuple[str, bool]], size: int, last: dict | None = None) -> DataFrame:
    """The next ``size`` rows behind the row with the values ``last`` (the first ones without): a filter and a top-k, whatever
    the number of pages before.  The columns of the order hold no nulls."""
    by = [F.asc(c) if up else F.desc(c) for c, up in order]
    if last is not None:
        behind = F.lit(False)
        for c, up in reversed(order):
            further = F.col(c) > F.lit(last[c]) if up else F.col(c) < F.lit(last[c])
            behind = further | ((F.col(c) == F.lit(last[c])) & behind)
        rows = rows.where(behind)
    return rows.orderBy(*by).limit(size)


def compare_filtered(gaps: DataFrame, filtered: DataFrame) -> DataFrame:
    """(sample, gap_bases, filtered_bases, concordant_bases, gap_only_bases, filtered_only_bases, concordance_pct) of gap
    intervals against the intervals that a caller masked, for samples with both kinds of input."""
    g, f = iv.merge(gaps, ["sample"]), iv.merge(filtered, ["sample"])
    size = F.sum(F.col("end") - F.col("start"))
    both = g.groupBy("sample").agg(size.alias("gap_bases")).join(f.groupBy("sample").agg(size.alias("filtered_bases")), "sample")
    hit = iv.overlapping(g, f.select(F.col("sample").alias("_s"), "start", "end"), ["_s"]).where("sample = _s")
    shared = hit.groupBy("sample").agg(F.sum(iv.overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("c"))
    o = both.join(shared, "sample", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    union = F.col("gap_bases") + F.col("filtered_bases") - F.col("c")
    return o.select("sample", "gap_bases", "filtered_bases", F.col("c").alias("concordant_bases"), (F.col("gap_bases") - F.col("c")).alias("gap_only_bases"), (F.col("filtered_bases") - F.col("c")).alias("filtered_only_bases"), F.when(union > 0, F.col("c") / union * 100).otherwise(100.0).alias("concordance_pct"))


def one_sided_regions(gaps: DataFrame, filtered: DataFrame, max_gap: int = 10) -> DataFrame:
    """(sample, side, start, end) of bases that only the gaps (gap_only) or only the caller (filtered_only) leaves out, regions
    at most ``max_gap`` apart joined; samples without one kind of input drop out."""
    both = gaps.select("sample").distinct().join(filtered.select("sample").distinct(), "sample")
    tagged = iv.merge(gaps, ["sample"]).withColumn("side", F.lit(1).cast("long")).unionByName(iv.merge(filtered, ["sample"]).withColumn("side", F.lit(2).cast("long")))
    alone = iv.sweep(tagged, ["sample"], weight="side").where("k < 3").join(both, "sample", "left_semi")
    return iv.merge(alone.select("sample", F.when(F.col("k") == 1, "gap_only").otherwise("filtered_only").alias("side"), "start", "end"), ["sample", "side"], max_gap)


def filtered_summary(samples: DataFrame) -> DataFrame:
    """One row over ``compare_filtered``: total_samples, avg_concordance_pct (0 without samples) and the summed bases."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return samples.agg(F.count(F.lit(1)).alias("total_samples"), F.coalesce(F.avg("concordance_pct"), F.lit(0.0)).alias("avg_concordance_pct"), *[z(c).alias(f"total_{c}") for c in ("concordant_bases", "gap_only_bases", "filtered_only_bases")])


def retention_summary(core: DataFrame, kept: DataFrame) -> DataFrame:
    """One row over ``core_difference`` and ``retention``: total_samples, avg_core_diff_pct (of absolute values, 0 without
    samples), avg_snp_retention_pct (100 without), total_snps, total_snps_in_gaps."""
    c = core.agg(F.count(F.lit(1)).alias("total_samples"), F.coalesce(F.avg(F.abs("core_diff_pct")), F.lit(0.0)).alias("avg_core_diff_pct"))
    z = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(f"total_{x}".replace("total_total", "total"))
    return c.crossJoin(kept.agg(F.coalesce(F.avg("retention_pct"), F.lit(100.0)).alias("avg_snp_retention_pct"), z("total_snps"), z("snps_in_gaps")))


def retention(calls: DataFrame, gaps: DataFrame) -> DataFrame:
    """(sample, total_snps, snps_in_gaps, snps_retained, retention_pct) of calls (sample, pos) against gaps."""
    hit = iv.locate(calls, iv.merge(gaps, ["sample"]), ["sample"], [])
    r = hit.groupBy("sample").agg(F.count(F.lit(1)).alias("total_snps"), F.count_if("inside").alias("snps_in_gaps"))
    kept = F.col("total_snps") - F.col("snps_in_gaps")
    return r.withColumn("snps_retained", kept).withColumn("retention_pct", kept / F.col("total_snps") * 100)


def core_difference(gaps: DataFrame, stats: DataFrame, ref_len: int) -> DataFrame:
    """(sample, core_size, gap_bases, core_diff, core_diff_pct, gaps_not_lowcov, lowcov_not_in_gaps) against a caller's own
    (sample, aligned, lowcov)."""
    g = iv.merge(gaps, ["sample"]).groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("gap_bases"))
    j = g.join(stats, "sample")
    core = F.greatest(F.lit(ref_len) - F.col("gap_bases"), F.lit(0))
    diff = core - F.col("aligned")
    return j.select("sample", core.cast("long").alias("core_size"), "gap_bases", diff.cast("long").alias("core_diff"), (diff / ref_len * 100).alias("core_diff_pct"), F.greatest(F.col("gap_bases") - F.col("lowcov"), F.lit(0)).cast("long").alias("gaps_not_lowcov"), F.greatest(F.col("lowcov") - F.col("gap_bases"), F.lit(0)).cast("long").alias("lowcov_not_in_gaps"))


def validate(observed: DataFrame) -> DataFrame:
    """(chrom, pos, samples, bases, verdict) of consensus bases (sample, chrom, pos, base) read back from
    alignments: artifact if two samples or more agree, real otherwise, no_data without a base."""
    g = observed.groupBy("chrom", "pos").agg(F.count("base").alias("samples"), F.count_distinct("base").alias("bases"))
    return g.withColumn("verdict", F.when(F.col("samples") == 0, "no_data").when((F.col("samples") >= 2) & (F.col("bases") == 1), "artifact").otherwise("real"))


def rank_by_priority(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The first row of each key by a priority column."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(priority))).where("_r = 1").drop("_r")
