"""Quality control of samples: gaps in common, metrics, scores, clusters, impact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.sources import fasta


def unique_shared(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, unique_bases, shared_bases): gap positions of one sample alone, and of several."""
    cover = iv.sweep(gaps, keys)
    hit = iv.overlapping(
        gaps.select(F.concat_ws("\x1f", *keys).alias("_key"), *keys, "sample", "start", "end") if keys else gaps.withColumn("_key", F.lit("")),
        cover.select(F.concat_ws("\x1f", *keys).alias("_rkey") if keys else F.lit("").alias("_rkey"), "start", "end", "k"),
        ["_rkey", "k"],
    ).where("_key = _rkey")
    size = iv.overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return hit.groupBy(*keys, "sample").agg(F.sum(F.when(F.col("k") == 1, size).otherwise(0)).alias("unique_bases"), F.sum(F.when(F.col("k") > 1, size).otherwise(0)).alias("shared_bases"))


def unique_regions(gaps: DataFrame) -> DataFrame:
    """(sample, start, end): the maximal runs in which a sample is gapped alone; ``gaps`` merged by sample."""
    alone = iv.sweep(gaps, []).where("k = 1").select("start", "end")
    hit = iv.overlapping(gaps.select("sample", "start", "end"), alone, [])
    return iv.merge(hit.select("sample", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end")), ["sample"])


def pairwise_gaps(gaps: DataFrame, samples: DataFrame, keys: list[str], ref_len: int) -> DataFrame:
    """(keys, a, b, gap_union, gap_intersection, quality, unique_a, unique_b, core) of every pair of
    ``samples`` (keys, sample).  Quality is the intersection over the union, 1 if there is no gap."""
    own = gaps.groupBy(*keys, "sample").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    full = samples.join(own, [*keys, "sample"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left = full.select(*keys, F.col("sample").alias("a"), F.col("n").alias("na"))
    right = full.select(*keys, F.col("sample").alias("b"), F.col("n").alias("nb"))
    pairs = (left.join(right, keys) if keys else left.crossJoin(right)).where("a < b")
    out = pairs.join(iv.pair_overlaps(gaps, keys, "sample"), [*keys, "a", "b"], "left").withColumn("i", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("i")
    return out.select(
        *keys, "a", "b", union.cast("long").alias("gap_union"), F.col("i").cast("long").alias("gap_intersection"), F.when(union == 0, 1.0).otherwise(F.col("i") / union).alias("quality"),
        (F.col("na") - F.col("i")).cast("long").alias("unique_a"), (F.col("nb") - F.col("i")).cast("long").alias("unique_b"), (F.lit(ref_len) - union).cast("long").alias("core"),
    )


def pair_metrics(pairs: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample, avg_quality, total_unique, avg_core) over the pairs with a sample: quality 1 without
    pairs, core an integer mean."""
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("sample"), F.col("unique_a").alias("u")), F.struct(F.col("b").alias("sample"), F.col("unique_b").alias("u")))).alias("x"), "quality", "core")
    agg = both.groupBy(*keys, F.col("x.sample").alias("sample")).agg(F.avg("quality").alias("q"), F.sum("x.u").alias("u"), F.expr("sum(core) div count(*)").alias("c"), F.min("quality").alias("m"))
    out = samples.join(agg, [*keys, "sample"], "left")
    return out.select(*keys, "sample", F.coalesce("q", F.lit(1.0)).alias("avg_quality"), F.coalesce("u", F.lit(0)).cast("long").alias("total_unique"), F.coalesce("c", F.lit(0)).cast("long").alias("avg_core"), F.coalesce("m", F.lit(1.0)).alias("min_quality"))


def dataset_quality(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean quality, the worst and the best pair (ties: first by name), pairs over 0.8 and under 0.2."""
    order = lambda sign: F.struct((F.col("quality") * sign).alias("q"), F.col("a"), F.col("b"))
    worst, best = F.min(order(1)), F.min(order(-1))
    return pairs.groupBy(*keys).agg(
        F.avg("quality").alias("mean_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"),
        F.concat_ws("-", worst["a"], worst["b"]).alias("worst_pair"), F.concat_ws("-", best["a"], best["b"]).alias("best_pair"),
        F.count_if(F.col("quality") > 0.8).alias("high_quality_pairs"), F.count_if(F.col("quality") < 0.2).alias("low_quality_pairs"),
    )


#: Shares of samples, in percent, for which a core is reported.
PERCENTS = (100.0, 95.0, 90.0, 80.0, 70.0, 50.0, 25.0)


def least_samples(percent: float, n: int) -> int:
    """The number of samples that a share of n needs, one at least."""
    return max(math.ceil(percent / 100 * n), 1)


def _grid(keys: DataFrame, n: int, percents) -> DataFrame:
    """The keys with each (threshold, min_samples)."""
    t = keys.sparkSession.createDataFrame([(p, least_samples(p, n)) for p in percents], "threshold double, min_samples long")
    return keys.crossJoin(F.broadcast(t))


def thresholds(gaps: DataFrame, keys: DataFrame, names: list[str], n: int, ref_len: int, percents=PERCENTS) -> DataFrame:
    """(keys, threshold, min_samples, core_size, empty_size): positions covered by enough samples."""
    cover = iv.sweep(gaps, names).groupBy(*names, "k").agg(F.sum(F.col("end") - F.col("start")).alias("m"))
    empty = _grid(keys, n, percents).join(cover, names, "left").groupBy(*names, "threshold", "min_samples").agg(F.coalesce(F.sum(F.when(F.lit(n) - F.col("k") < F.col("min_samples"), F.col("m"))), F.lit(0)).alias("e"))
    return empty.select(*names, "threshold", "min_samples", (F.lit(ref_len) - F.col("e")).cast("long").alias("core_size"), F.col("e").cast("long").alias("empty_size"))


def empty_regions(gaps: DataFrame, keys: DataFrame, names: list[str], n: int, percents=PERCENTS) -> DataFrame:
    """(keys, threshold, min_samples, start, end): for each threshold the maximal runs that too few samples cover, all from
    one sweep of the merged gaps.  A run for more samples is part of one for fewer, and thresholds that need the same number
    of samples have the same runs."""
    runs = iv.level_runs(iv.sweep(gaps, names), names, [n - least_samples(p, n) + 1 for p in percents])
    grid = _grid(keys, n, percents).withColumn("level", F.lit(n) - F.col("min_samples") + 1)
    return grid.join(runs, [*names, "level"]).select(*names, "threshold", "min_samples", "start", "end")


def threshold_summary(regions: DataFrame, keys: DataFrame, names: list[str], n: int, ref_len: int, percents=PERCENTS) -> DataFrame:
    """(keys, threshold, min_samples, core_size, core_pct, empty_size, regions, longest) over ``empty_regions``."""
    size = F.col("end") - F.col("start")
    agg = regions.groupBy(*names, "threshold").agg(F.sum(size).alias("e"), F.count(F.lit(1)).alias("r"), F.max(size).alias("l"))
    out = _grid(keys, n, percents).join(agg, [*names, "threshold"], "left").na.fill(0, ["e", "r", "l"])
    core = F.lit(ref_len) - F.col("e")
    return out.select(*names, "threshold", "min_samples", core.cast("long").alias("core_size"), (core / ref_len * 100).alias("core_pct"), F.col("e").cast("long").alias("empty_size"), F.col("r").alias("regions"), F.col("l").cast("long").alias("longest"))


def full_histogram(gaps: DataFrame, keys: DataFrame, names: list[str], n: int, ref_len: int) -> DataFrame:
    """(keys, covered, positions): positions covered by exactly 0..n samples, zeros included."""
    cover = iv.sweep(gaps, names).groupBy(*names, "k").agg(F.sum(F.col("end") - F.col("start")).alias("m"))
    grid = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    rows = grid.join(cover, [*names, "k"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    w = Window.partitionBy(*names)
    rest = F.lit(ref_len) - F.sum("m").over(w)
    return rows.select(*names, (F.lit(n) - F.col("k")).cast("long").alias("covered"), F.when(F.col("k") == 0, rest).otherwise(F.col("m")).cast("long").alias("positions"))


def fragile_regions(gaps: DataFrame, names: list[str], n: int, least: int = 100) -> DataFrame:
    """(keys, start, end, max_coverage, max_coverage_pct, samples): runs of ``least`` positions or more that fewer than
    half of the samples cover, with the samples gapped in them."""
    cover = iv.sweep(gaps, names)
    level = n - least_samples(50.0, n) + 1
    runs = iv.level_runs(cover, names, [level]).drop("level").where(F.col("end") - F.col("start") >= least)
    tag = F.concat_ws("\x1f", *names) if names else F.lit("")
    tagged = runs.withColumn("_key", tag)
    hit = iv.overlapping(tagged, gaps.select(tag.alias("_g"), "start", "end", "sample"), ["_g", "sample"]).where("_key = _g")
    samples = hit.groupBy(*names, "start", "end").agg(F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("samples"))
    seg = iv.overlapping(tagged, cover.where(F.col("k") >= level).select(tag.alias("_g"), "start", "end", "k"), ["_g", "k"]).where("_key = _g")
    most = F.lit(n) - F.min("k")
    most = seg.groupBy(*names, "start", "end").agg(most.cast("long").alias("max_coverage"), (most / n * 100).alias("max_coverage_pct"))
    return most.join(samples, [*names, "start", "end"])


def zscore(value: str, names: list[str]):
    """Distance from the mean in population standard deviations, 0 if they are 0."""
    w = Window.partitionBy(*names)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)


def n50(contigs: DataFrame) -> DataFrame:
    """(sample, n_contigs, total_length, n50): the length at which half of the total (whole division) is reached."""
    w = Window.partitionBy("sample").orderBy(F.desc("length"), "contig")
    c = contigs.withColumn("run", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("length").over(Window.partitionBy("sample")))
    return c.groupBy("sample").agg(F.count(F.lit(1)).alias("n_contigs"), F.max("total").cast("long").alias("total_length"), F.max(F.when(F.expr("run >= total div 2"), F.col("length"))).alias("n50"))


#: Letters that are hashed at once.
PIECE = 1 << 16


def content_duplicates(contigs: DataFrame) -> DataFrame:
    """(sample, digest, keep) of records (sample, contig_idx, sequence) or chunks (sample, contig_idx, at, bases): samples of the same
    upper-cased contigs, in any order and under any names, have one digest; the first sample of each is kept.

    Letters are hashed where they are, in pieces at fixed places of a contig; a contig's digest is that of its pieces' in
    order, a sample's that of its contigs' sorted, so no row holds a sequence."""
    joint = lambda c, order: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["d"]), ""))
    parts = contigs if "bases" in contigs.columns else fasta.cut(contigs)
    pieces = fasta.pieces(parts, "at", PIECE, ["sample", "contig_idx"]).select("sample", "contig_idx", "k", F.md5(F.upper("bases")).alias("d"))
    each = pieces.groupBy("sample", "contig_idx").agg(joint("d", F.struct("k", "d")).alias("d"))
    own = each.groupBy("sample").agg(joint("d", F.struct("d")).alias("digest"))
    # A sample without a letter has no piece.
    d = parts.select("sample").distinct().join(own, "sample", "left").withColumn("digest", F.coalesce("digest", F.md5(F.lit(""))))
    first = d.groupBy("digest").agg(F.min("sample").alias("_first"))
    return d.join(first, "digest").select("sample", "digest", (F.col("sample") == F.col("_first")).alias("keep"))


def duplicate_groups(found: DataFrame) -> DataFrame:
    """(sample, n, samples) over ``content_duplicates``: each sample that is kept, with how many have its content and their names,
    sorted and joined by commas.  A group's names are one row."""
    g = found.groupBy("digest").agg(F.min("sample").alias("sample"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("samples"))
    return g.select("sample", "n", "samples")


def median_upper(values: str):
    """The upper median: the element at n div 2 of the sorted values."""
    return F.expr(f"element_at(array_sort(collect_list({values})), CAST(count({values}) div 2 AS INT) + 1)")


#: Flags of the score with their conditions and weights, in order.
FLAGS = (
    ("LowIdentity", "ref_identity < min_identity", 0.3),
    ("LowCoverage", "ref_coverage < 0.9", 0.2),
    ("HighUnaligned", "avg_quality < 0.3", 0.25),
    ("IdentityOutlier", "coverage_z < -2", 0.2),
    ("UnalignedOutlier", "quality_z < -2", 0.2),
    ("HighFragmentation", "median_n50 > 0 AND n50 < median_n50 div 2", 0.15),
    ("LowRefIdentity", "unique_ratio > 0.02", 0.3),
)


def score(metrics: DataFrame, min_identity: float) -> DataFrame:
    """Adds score (0 to 1), flags and recommendation (EXCLUDE, REVIEW, OK).

    ``metrics`` has sample, ref_identity, ref_coverage, avg_quality, n50, total_length, total_unique."""
    median = metrics.select(median_upper("n50").alias("median_n50"))
    m = metrics.crossJoin(F.broadcast(median)).withColumn("min_identity", F.lit(min_identity))
    m = m.withColumn("coverage_z", zscore("ref_coverage", [])).withColumn("quality_z", zscore("avg_quality", []))
    m = m.withColumn("unique_ratio", F.when(F.col("total_length") > 0, F.col("total_unique") / F.col("total_length")).otherwise(0.0))
    total = F.when((F.col("unique_ratio") > 0.005) & (F.col("unique_ratio") <= 0.02), 0.1).otherwise(0.0)
    for _, cond, weight in FLAGS:
        total = total + F.when(F.expr(cond), weight).otherwise(0.0)
    flags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c, _ in FLAGS]))
    m = m.withColumn("score", F.least(total, F.lit(1.0))).withColumn("flags", flags)
    rec = F.when(F.col("score") >= 0.5, "EXCLUDE").when((F.col("score") >= 0.2) | (F.size("flags") > 0), "REVIEW").otherwise("OK")
    return m.withColumn("recommendation", rec).drop("min_identity")


def summary(scored: DataFrame) -> DataFrame:
    r = F.col("recommendation")
    return scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(r == "OK").alias("ok"), F.count_if(r == "REVIEW").alias("review"), F.count_if(r == "EXCLUDE").alias("exclude"), F.avg("ref_coverage").alias("avg_coverage"), F.min("ref_coverage").alias("min_coverage"))


def outliers(samples: DataFrame) -> DataFrame:
    """(sample, severity, reason) of samples (sample, ref_coverage, avg_quality, mean_quality) that stand out."""
    c, q, m = F.col("ref_coverage"), F.col("avg_quality"), F.col("mean_quality")
    severity = F.when(c < 0.90, "Major").when(c < 0.95, "Moderate").when((q < 0.2) & (m > 0.5), "Major").when(q < m - 0.3, "Moderate")
    reason = (
        F.when(c < 0.90, F.format_string("Low reference coverage: %.1f%%", c * 100))
        .when(c < 0.95, F.format_string("Moderate reference coverage: %.1f%%", c * 100))
        .when((q < 0.2) & (m > 0.5), F.format_string("Low gap quality: %.2f (mean: %.2f)", q, m))
        .when(q < m - 0.3, F.format_string("Below average gap quality: %.2f", q))
    )
    return samples.withColumn("severity", severity).withColumn("reason", reason).where("severity IS NOT NULL")


TIERS = (("HighCoverage", 0.99), ("GoodCoverage", 0.95), ("ModerateCoverage", 0.90), ("LowCoverage", -1.0))


def clusters(samples: DataFrame) -> DataFrame:
    """(id, cluster_type, n_samples, min_coverage, avg_coverage, avg_quality): coverage tiers with more than
    one sample, numbered from 0 from the highest tier."""
    tier = None
    for i, (_, least) in enumerate(TIERS):
        c = F.col("ref_coverage") >= least
        tier = F.when(c, i) if tier is None else tier.when(c, i)
    g = samples.withColumn("t", tier).groupBy("t").agg(F.count(F.lit(1)).alias("n_samples"), F.min("ref_coverage").alias("min_coverage"), F.avg("ref_coverage").alias("avg_coverage"), F.avg("avg_quality").alias("avg_quality"))
    names = F.array(*[F.lit(n) for n, _ in TIERS])
    return g.where("n_samples > 1").select((F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("id"), F.element_at(names, F.col("t") + 1).alias("cluster_type"), "n_samples", "min_coverage", "avg_coverage", "avg_quality")


def pattern(samples: DataFrame, found: DataFrame, quality: DataFrame) -> DataFrame:
    """(pattern) of the set: Insufficient, AllHighCoverage, HighCoverageWithOutliers, HighGapDiversity or
    VariableCoverage."""
    a = samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ref_coverage") >= 0.95).alias("high"))
    b = found.agg(F.count(F.lit(1)).alias("outliers"), F.count_if(F.col("severity") == "Major").alias("major"))
    p = (
        F.when(F.col("n") < 2, "Insufficient")
        .when((F.col("high") == F.col("n")) & (F.col("outliers") == 0), "AllHighCoverage")
        .when((F.col("high") > 0) & (F.col("major") > 0), "HighCoverageWithOutliers")
        .when(F.col("low_quality_pairs") > F.col("high_quality_pairs"), "HighGapDiversity")
        .otherwise("VariableCoverage")
    )
    return a.crossJoin(b).crossJoin(quality.select("low_quality_pairs", "high_quality_pairs")).select(p.alias("pattern"))


def impact(gaps: DataFrame, samples: DataFrame, quality: DataFrame, ref_len: int) -> DataFrame:
    """(sample, gap_bases, unique_bases, shared_bases, core_loss_pct, risk) of each sample: the share of the
    reference that only its gaps take, and Critical, High, Medium or Low."""
    own = gaps.groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("gap_bases"))
    m = samples.join(own, "sample", "left").join(unique_shared(gaps, []), "sample", "left").join(quality.select("sample", "avg_quality"), "sample", "left")
    m = m.select("sample", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gap_bases", "unique_bases", "shared_bases")], F.coalesce("avg_quality", F.lit(1.0)).alias("avg_quality"))
    pct = F.col("unique_bases") / ref_len * 100
    risk = F.when(pct > 5, "Critical").when(pct > 2, "High").when((pct > 0.5) | (F.col("avg_quality") < 0.3), "Medium").otherwise("Low")
    return m.withColumn("core_loss_pct", pct).withColumn("risk", risk).drop("avg_quality")
