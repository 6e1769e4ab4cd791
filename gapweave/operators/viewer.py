"""What the report pages compute: what-if cores, filters, bands, display alleles and texts."""

from __future__ import annotations

from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators.qc import unique_shared


def what_if_core(gaps: DataFrame, selected: list[str], ref_len: int, unique_only: bool = True) -> DataFrame:
    """(core): the reference less the gaps of the selected samples; ``unique_only`` counts only gaps that a sample has
    alone among all, as the page does, else all of theirs."""
    if unique_only:
        lost = unique_shared(gaps, []).where(F.col("sample").isin(selected)).agg(F.coalesce(F.sum("unique_bases"), F.lit(0)).alias("n"))
    else:
        lost = iv.sweep(gaps.where(F.col("sample").isin(selected)), []).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n"))
    return lost.select((F.lit(ref_len) - F.col("n")).cast("long").alias("core"))


def all_sample_kpis(calls: DataFrame, n_samples: int) -> DataFrame:
    """(all_a, all_b, both): positions that every sample calls, in pipeline a, in b, and in both; ``calls`` have the
    pipelines a and b."""
    g = calls.groupBy("pipeline", "pos").agg(F.count_distinct("sample").alias("m")).where(F.col("m") == n_samples)
    w = g.groupBy("pos").agg(F.max(F.col("pipeline") == "a").alias("a"), F.max(F.col("pipeline") == "b").alias("b"))
    return w.agg(F.count_if("a").alias("all_a"), F.count_if("b").alias("all_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))


def corrected_concordance(concordant: Column, a: Column, b: Column) -> Column:
    n = concordant + a + b
    return F.when(n > 0, concordant / n * 100).otherwise(0.0)


def display_allele(gapped: Column, a: Column, b: Column, ref: Column) -> Column:
    """A gap before all, then the allele both have, the reference if they differ, the only one, the reference."""
    return F.when(gapped, "-").when(a == b, a).when(a.isNotNull() & b.isNotNull(), ref).otherwise(F.coalesce(a, b, ref))


def quality_band(q: Column) -> Column:
    return F.when(q >= 0.8, "high").when(q >= 0.5, "good").when(q >= 0.2, "moderate").otherwise("low")


def filter_pairs(pairs: DataFrame, ref_len: int, least_reduction_pct: float | None = None, band: str = "all") -> DataFrame:
    """Pairs whose core loses more than a share of the reference, or of a quality band."""
    out = pairs.withColumn("reduction_pct", (F.lit(ref_len) - F.col("core")) / ref_len * 100).withColumn("band", quality_band(F.col("quality")))
    if least_reduction_pct is not None:
        out = out.where(F.col("reduction_pct") > least_reduction_pct)
    return out if band == "all" else out.where(F.col("band") == band)


def track_summary(parts: DataFrame, ref_len: int) -> DataFrame:
    """(sample, covered_pct, unique_pct, shared_pct) of (sample, unique_bases, shared_bases)."""
    gap = F.col("unique_bases") + F.col("shared_bases")
    share = lambda c: F.when(gap > 0, F.col(c) / gap * 100).otherwise(0.0)
    return parts.select("sample", ((F.lit(ref_len) - gap) / ref_len * 100).alias("covered_pct"), share("unique_bases").alias("unique_pct"), share("shared_bases").alias("shared_pct"))


def risk_text(impact: DataFrame) -> Column:
    """The recommendation of a risk level, for columns risk, core_loss_pct, unique_bases and avg_quality."""
    p, u = F.col("core_loss_pct"), F.col("unique_bases")
    return (
        F.when(F.col("risk") == "Critical", F.format_string("EXCLUDE: Would reduce core by %.1f%% (%d unique gap bases). Severely damages SNP resolution.", p, u))
        .when(F.col("risk") == "High", F.format_string("REVIEW: Would reduce core by %.1f%% (%d unique gap bases). Consider excluding.", p, u))
        .when(F.col("risk") == "Medium", F.format_string("CAUTION: Core reduction %.2f%% (%d unique gaps). Gap quality: %.2f", p, u, F.col("avg_quality")))
        .otherwise(F.format_string("OK: Minimal impact (%.3f%%, %d unique gaps). Gap quality: %.2f", p, u, F.col("avg_quality")))
    )


def retention_text(pct: Column) -> Column:
    return F.when(pct > 99, "Excellent: gaps do not affect variant calling").when(pct > 95, "Good: most SNPs are preserved outside gap regions").when(pct > 90, "Moderate: some SNPs fall in gaps - review thresholds").otherwise("Warning: significant SNP loss in gaps - consider adjusting parameters")


def concordance_text(pct: Column, gap_only: Column, filtered_only: Column) -> Column:
    return F.when(pct > 80, "High concordance").when(pct > 50, "Moderate concordance: some differences in filtering approach").when(gap_only > filtered_only, "Low concordance: gaps flag more regions").otherwise("Low concordance: the pipeline applies additional quality filters")


#: Advice for each pattern of a sample set, in order.
ADVICE = {
    "AllHighCoverage": ("Use CLOSE reference (>99% ANI) to avoid alignment artifacts", "Strict variant callers may miss real SNPs - use sensitive settings", "Verify any 'polymorphic' SNPs with BAM-level validation"),
    "HighCoverageWithOutliers": ("Consider analyzing high-coverage samples separately",),
    "HighGapDiversity": ("Large core reduction expected - verify this is intended", "Consider using soft-core (95%) instead of strict core (100%)"),
    "VariableCoverage": ("Variable coverage - check assembly/sequencing quality",),
    "Insufficient": (),
}


def warnings(samples: DataFrame, outliers: DataFrame, quality: DataFrame) -> DataFrame:
    """(text) warnings of low coverage, low or diverse gap quality, and major outliers."""
    low = samples.where("ref_coverage < 0.95").select(F.format_string("REFERENCE: %s covers only %.1f%% of reference - missing regions", "sample", F.col("ref_coverage") * 100).alias("text"))
    q = quality.where("mean_quality < 0.5").select(F.format_string("LOW GAP QUALITY: Dataset quality score %.2f - samples have very different gap patterns", "mean_quality").alias("text"))
    d = quality.where("low_quality_pairs > 0").select(F.format_string("GAP DIVERSITY: %d sample pairs have low gap overlap (quality < 0.2)", "low_quality_pairs").alias("text"))
    m = outliers.where("severity = 'Major'").select(F.format_string("MAJOR OUTLIER: %s - %s", "sample", "reason").alias("text"))
    return low.union(q).union(d).union(m)


def parse_query(text: str) -> dict[str, str]:
    """The parameters of a query string; without an equals sign a part is ignored."""
    return {unquote_plus(k): unquote_plus(v) for k, _, v in (p.partition("=") for p in text.lstrip("?").split("&")) if _}


def duration(seconds: float) -> str:
    return f"{seconds:.1f}s" if seconds < 60 else f"{int(seconds // 60)}m {int(seconds % 60)}s"


def by_unique_gaps(impact: DataFrame) -> DataFrame:
    """(sample, unique_bases, place) from the fewest bases that only a sample lacks; ties by name.  One row a sample."""
    w = Window.orderBy("unique_bases", "sample")
    return impact.select("sample", "unique_bases", F.row_number().over(w).cast("long").alias("place"))
