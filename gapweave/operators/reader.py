"""What readers of a report ask for: totals, statistics per sample and pair of pipelines, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.functions import variants as va
from gapweave.operators import reader_v1, sites


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def kpi_totals(calls: DataFrame, ref_base: DataFrame, samples: DataFrame, pipelines: DataFrame, gt: str, ref_len: int, carriers: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row, what the first reader version reports beside its counts by pipeline: gt_total_snps (calls alike the
    reference included), core_gt_total, consensus_gt_total, samples, pipelines, ref_length.  ``carriers`` and ``parts`` as in
    ``reader_v1.kpis``."""
    is_gt = F.col("pipeline") == gt
    truth = calls.where(is_gt)
    core = reader_v1.core_positions(reader_v1.marked(truth, ref_base, gt, parts=parts), truth if carriers is None else carriers.where(is_gt))
    total = core.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("gt_total_snps"), F.count_if("core").alias("core_gt_total"), F.count_if("consensus").alias("consensus_gt_total"))
    size = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return total.crossJoin(size(samples, "samples")).crossJoin(size(pipelines, "pipelines")).withColumn("ref_length", F.lit(ref_len).cast("long"))


def pair_usable(pairs: DataFrame, pipelines: DataFrame, ref_len: int) -> DataFrame:
    """(pipeline, avg_usable_space, avg_usable_space_pct, avg_usable_snps, min_usable_snps, max_usable_snps,
    median_usable_snps, num_pairs) over ``sites.pair_stats``; without a pair all space is usable and the rest is 0."""
    s = pipelines.join(sites.pair_summary(pairs), "pipeline", "left")
    space = F.coalesce("usable_avg", F.lit(float(ref_len)))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return s.select(
        "pipeline", space.alias("avg_usable_space"), (space / ref_len * 100).alias("avg_usable_space_pct"), zero("disc_avg").alias("avg_usable_snps"), F.coalesce("disc_min", F.lit(0)).alias("min_usable_snps"),
        F.coalesce("disc_max", F.lit(0)).alias("max_usable_snps"), zero("disc_median").alias("median_usable_snps"), _n("num_pairs"),
    )


def pair_usable_samples(pairs: DataFrame, ref_len: int) -> DataFrame:
    """(pipeline, sample, avg_usable_space, avg_usable_space_pct, avg_disc_snps) over the pairs with a sample."""
    s = sites.per_sample_pairs(pairs).drop("num_pairs")
    return s.withColumn("avg_usable_space_pct", F.col("avg_usable_space") / ref_len * 100)


def per_sample_stats(calls: DataFrame, gaps: DataFrame, samples: DataFrame, pipelines: DataFrame, gt: str) -> DataFrame:
    """(sample, pipeline, snps, snps_in_gt_gaps, gt_snps, intersection, agreement_with_gt, pct_of_pipeline, pct_of_gt) of
    each pipeline but the truth: shared positions, those with the same alt, and shares of both call sets (0 for none)."""
    truth = calls.where(F.col("pipeline") == gt).select("sample", "pos", F.col("alt").alias("t"))
    mine = calls.where(F.col("pipeline") != gt).select("sample", "pipeline", "pos", "alt").join(truth, ["sample", "pos"], "left")
    own = iv.merge(gaps.where(F.col("pipeline") == gt), ["sample"])
    hit = iv.locate(mine, own, ["sample"], []).groupBy("sample", "pipeline")
    hit = hit.agg(F.count(F.lit(1)).alias("snps"), F.count_if("inside").alias("snps_in_gt_gaps"), F.count("t").alias("intersection"), F.count_if(F.col("alt") == F.col("t")).alias("agreement_with_gt"))
    grid = samples.select("sample").crossJoin(F.broadcast(pipelines.where(F.col("pipeline") != gt)))
    out = grid.join(hit, ["sample", "pipeline"], "left").join(truth.groupBy("sample").agg(F.count(F.lit(1)).alias("gt_snps")), "sample", "left")
    out = out.select("sample", "pipeline", *map(_n, ("snps", "snps_in_gt_gaps", "gt_snps", "intersection", "agreement_with_gt")))
    return out.withColumn("pct_of_pipeline", va.percent("intersection", "snps")).withColumn("pct_of_gt", va.percent("intersection", "gt_snps"))


def coverage_stats(gaps: DataFrame, samples: DataFrame, pipelines: DataFrame, ref_len: int) -> DataFrame:
    """(sample, pipeline, gap_regions, gap_bases, covered_bases, coverage_pct) over merged gaps."""
    own = iv.merge(gaps, ["pipeline", "sample"]).groupBy("sample", "pipeline").agg(F.count(F.lit(1)).alias("gap_regions"), F.sum(F.col("end") - F.col("start")).alias("gap_bases"))
    out = samples.select("sample").crossJoin(F.broadcast(pipelines)).join(own, ["sample", "pipeline"], "left").select("sample", "pipeline", _n("gap_regions"), _n("gap_bases"))
    return out.withColumn("covered_bases", F.lit(ref_len) - F.col("gap_bases")).withColumn("coverage_pct", F.col("covered_bases") / ref_len * 100)


def truth_pileup(calls: DataFrame, gaps: DataFrame, samples: DataFrame, pipelines: DataFrame, gt: str, ref_len: int) -> DataFrame:
    """(sample, pipeline, total_snps, covered_positions, shared, gt_only, pipeline_only) of the truth against each pipeline."""
    stats = per_sample_stats(calls, gaps, samples, pipelines, gt)
    cover = coverage_stats(gaps, samples, pipelines, ref_len).where(F.col("pipeline") == gt).select("sample", F.col("covered_bases").alias("covered_positions"))
    return stats.join(cover, "sample").select("sample", "pipeline", F.col("gt_snps").alias("total_snps"), "covered_positions", F.col("intersection").alias("shared"), (F.col("gt_snps") - F.col("intersection")).alias("gt_only"), (F.col("snps") - F.col("intersection")).alias("pipeline_only"))


def consensus_stats(calls: DataFrame, pipelines: list[str], gt: str) -> DataFrame:
    """(sample, consensus, in_gt, agree_with_gt): positions of a sample that all the named pipelines call with one alt, those
    that the truth calls too, and calls alike; the row of a null sample sums all."""
    n = len(set(pipelines))
    g = calls.where(F.col("pipeline").isin(*pipelines, gt)).groupBy("sample", "pos")
    named = F.col("pipeline").isin(*pipelines)
    g = g.agg(F.count_distinct(F.when(named, F.col("pipeline"))).alias("m"), F.min(F.when(named, F.col("alt"))).alias("lo"), F.max(F.when(named, F.col("alt"))).alias("hi"), F.max(F.when(F.col("pipeline") == gt, F.col("alt"))).alias("t"))
    return g.where((F.col("m") == n) & (F.col("lo") == F.col("hi"))).rollup("sample").agg(F.count(F.lit(1)).alias("consensus"), F.count("t").alias("in_gt"), F.count_if(F.col("t") == F.col("lo")).alias("agree_with_gt"))


def concordance(calls: DataFrame, n_samples: int) -> DataFrame:
    """(a, b, concordance_any, concordance_all, consensus_any, consensus_all) of pairs of pipelines: positions that at least one
    sample, or all samples, have called in both, and with the same alt in both."""
    side = lambda p: calls.select(F.col("pipeline").alias(p), "sample", "pos", F.col("alt").alias(f"{p}_alt"))
    g = side("a").join(side("b"), ["sample", "pos"]).where("a < b").groupBy("a", "b", "pos")
    g = g.agg(F.count_distinct("sample").alias("m"), F.count_distinct(F.when(F.col("a_alt") == F.col("b_alt"), F.col("sample"))).alias("same"))
    ids = calls.select("pipeline").distinct()
    grid = ids.select(F.col("pipeline").alias("a")).crossJoin(F.broadcast(ids.select(F.col("pipeline").alias("b")))).where("a < b")
    agg = g.groupBy("a", "b").agg(F.count(F.lit(1)).alias("concordance_any"), F.count_if(F.col("m") == n_samples).alias("concordance_all"), F.count_if(F.col("same") > 0).alias("consensus_any"), F.count_if(F.col("same") == n_samples).alias("consensus_all"))
    return grid.join(agg, ["a", "b"], "left").select("a", "b", *map(_n, ("concordance_any", "concordance_all", "consensus_any", "consensus_all")))


def mnp_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mnps_found, snps_from_mnps) of VCF rows (pos, ref, alt): an MNP counts even where no base of it differs."""
    mnp = va.is_mnp("ref", "alt")
    parts = F.when(mnp, F.size(va.decompose("pos", "ref", "alt"))).otherwise(0)
    return rows.groupBy(*keys).agg(F.count_if(mnp).alias("mnps_found"), F.coalesce(F.sum(parts), F.lit(0)).cast("long").alias("snps_from_mnps"))


def mnp_warning(stats: DataFrame) -> DataFrame:
    """(text) the warning of a report, no row without an MNP."""
    s = stats.agg(F.coalesce(F.sum("mnps_found"), F.lit(0)).alias("m"), F.coalesce(F.sum("snps_from_mnps"), F.lit(0)).alias("s")).where("m > 0")
    return s.select(F.format_string("Detected %d MNP(s) (multi-nucleotide polymorphisms) which were automatically decomposed into %d individual SNPs", "m", "s").alias("text"))


def lookup(points: DataFrame, calls: DataFrame, gaps: DataFrame, ref_base: DataFrame) -> DataFrame:
    """Adds to points (pipeline, sample, pos) what is known there: ref_nuc, alt, snp (``ref,alt,qual,depth``, empty without
    a call) and is_gap.  Points outside the reference have a null ref_nuc."""
    known = calls.select("pipeline", "sample", "pos", "alt", "qual", "dp")
    j = points.join(ref_base.select("pos", F.col("base").alias("ref_nuc")), "pos", "left").join(known, ["pipeline", "sample", "pos"], "left")
    j = iv.locate(j, iv.merge(gaps, ["pipeline", "sample"]), ["pipeline", "sample"], []).withColumnRenamed("inside", "is_gap")
    text = F.concat_ws(",", "ref_nuc", "alt", F.col("qual").cast("string"), F.col("dp").cast("string"))
    return j.withColumn("snp", F.when(F.col("alt").isNotNull(), text).otherwise("")).drop("qual", "dp")


def pair_lookup(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs (a < b) for wanted (a, b) in either order, under the names as wanted."""
    key = wanted.select(F.col("a").alias("want_a"), F.col("b").alias("want_b"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return key.join(pairs, ["a", "b"]).select(F.col("want_a").alias("a"), F.col("want_b").alias("b"), *rest)


def labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Adds ``label`` from labels (id, label); an id without one is its own label."""
    return rows.join(labels.select(F.col("id").alias(key), "label"), key, "left").withColumn("label", F.coalesce("label", F.col(key)))
