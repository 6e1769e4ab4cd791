"""The first version of the report reader: raw positions, calls alike the reference kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv


#: Width of the bins in which calls, gaps and reference meet.
BIN = 512


def core_positions(marked: DataFrame, carriers: DataFrame) -> DataFrame:
    """A row per (bin, pipeline, pos) of marked calls with their counts (calls, snps, called, inside) and whether the position is gapped;
    core: every sample having the pipeline calls it, calls of the reference base included; consensus: core, and all of them
    differ from the reference in the same way."""
    named = F.col("sample").isNotNull() & F.col("pos").isNotNull()
    at = marked.groupBy("bin", "pos", "pipeline").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("alt") != F.col("base")).alias("snps"), F.count_if(named & F.col("in_truth")).alias("called"), F.count_if(named & F.col("inside")).alias("inside"),
        F.count_if(named & F.col("first")).alias("m"), F.min("alt").alias("least"), F.max("alt").alias("most"), F.max("base").alias("base"), F.max("gapped").alias("gapped"),
    )
    n = carriers.groupBy("pipeline").agg(F.count_distinct("sample").alias("n"))
    core = F.coalesce(F.col("base").isNotNull() & (F.col("m") == F.col("n")), F.lit(False))
    consensus = F.col("core") & F.coalesce((F.col("least") == F.col("most")) & (F.col("least") != F.col("base")), F.lit(False))
    return at.join(F.broadcast(n), "pipeline", "left").withColumn("core", core).withColumn("consensus", consensus)


def marked(calls: DataFrame, ref_base: DataFrame, gt: str, gaps: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Calls with what ``core_positions`` counts: the base of the reference, whether a call is the first of its pipeline and sample at its
    position (first), whether the truth calls it (in_truth), whether a gap of the truth holds it (inside) or its position (gapped).

    Calls are read once and meet the gaps of the truth and the reference within bins of positions, without a join: the gaps
    seen so far in the order of positions tell whether one reaches over a call.  Calls that come with their ``bin``, dealt by it
    to so many ``parts``, stay there."""
    is_gt = F.col("pipeline") == gt
    dealt = lambda df: df if parts is None else df.repartition(parts, "bin")
    if "bin" not in calls.columns:
        calls = dealt(calls.withColumn("bin", iv.bin_of("pos", BIN)))
    rows = calls.select("bin", "sample", "pos", "pipeline", "alt")
    if gaps is None:
        rows = rows.withColumn("end", F.lit(None).cast("long"))
    else:
        # Of the gaps that begin at one place the longest counts, so a bin holds no more of them than it has positions.
        own = iv.binned(gaps.where(is_gt).select("sample", "start", "end"), BIN, clip=True).groupBy("bin", "sample", "start").agg(F.max("end").alias("end"))
        rows = rows.unionByName(dealt(own).select("bin", "sample", F.col("start").alias("pos"), "end"), allowMissingColumns=True)
    again = F.lag("pipeline").over(Window.partitionBy("bin", "sample", "pos").orderBy("pipeline")).eqNullSafe(F.col("pipeline"))
    mine = Window.partitionBy("bin", "sample").orderBy("pos")
    at = Window.currentRow
    rows = rows.withColumn("first", ~again).withColumn("in_truth", F.max(is_gt).over(mine.rangeBetween(at, at))).withColumn("inside", F.max("end").over(mine) > F.col("pos"))
    ref = dealt(ref_base.where("pos IS NOT NULL").select(iv.bin_of("pos", BIN).alias("bin"), "pos", "base"))
    everyone = Window.partitionBy("bin").orderBy("pos")
    out = rows.unionByName(ref, allowMissingColumns=True).withColumn("gapped", F.max("end").over(everyone) > F.col("pos")).withColumn("base", F.max("base").over(everyone.rangeBetween(at, at)))
    return out.where("pipeline IS NOT NULL")


def kpis(calls: DataFrame, gaps: DataFrame, ref_base: DataFrame, pipelines: DataFrame, gt: str, carriers: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """A row per pipeline: snps, gaps, core_snps, consensus_snps, gt_snps_missing, gt_snps_called, core_gt_missing,
    consensus_gt_missing, snps_in_gt_gaps_total, _core and _consensus; the comparisons are null for the truth itself.

    One pass, as ``marked`` has it.  ``carriers`` has the (pipeline, sample) of the calls where a plainer table tells them."""
    is_gt = F.col("pipeline") == gt
    size = gaps.groupBy("pipeline").agg(F.sum(F.col("end") - F.col("start")).alias("gaps"))
    core = core_positions(marked(calls, ref_base, gt, gaps, parts), calls if carriers is None else carriers)
    here = Window.partitionBy("bin", "pos")
    core = core.withColumn("gc", F.max(is_gt & F.col("core")).over(here)).withColumn("gn", F.max(is_gt & F.col("consensus")).over(here))
    counts = core.groupBy("pipeline").agg(
        F.sum("calls").alias("t"), F.sum("snps").alias("snps"), F.sum("called").alias("gt_snps_called"), F.sum("inside").alias("snps_in_gt_gaps_total"),
        F.count_if("core").alias("core_snps"), F.count_if("consensus").alias("consensus_snps"), F.count_if(F.col("core") & F.col("gc")).alias("cs"), F.count_if(F.col("consensus") & F.col("gn")).alias("ns"),
        F.count_if(F.col("core") & F.col("gapped")).alias("snps_in_gt_gaps_core"), F.count_if(F.col("consensus") & F.col("gapped")).alias("snps_in_gt_gaps_consensus"),
    )
    out = pipelines.join(counts, "pipeline", "left").join(size, "pipeline", "left")
    all_rows = Window.partitionBy(F.lit(0))  # a row for each pipeline
    of_gt = lambda c: F.coalesce(F.max(F.when(is_gt, F.col(c))).over(all_rows), F.lit(0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    vs = lambda x: F.when(~is_gt, x)
    return out.select(
        "pipeline", *[z(c).alias(c) for c in ("snps", "gaps", "core_snps", "consensus_snps")], vs(of_gt("t") - z("gt_snps_called")).alias("gt_snps_missing"), vs(z("gt_snps_called")).alias("gt_snps_called"),
        vs(of_gt("core_snps") - z("cs")).alias("core_gt_missing"), vs(of_gt("consensus_snps") - z("ns")).alias("consensus_gt_missing"), *[vs(z(c)).alias(c) for c in ("snps_in_gt_gaps_total", "snps_in_gt_gaps_core", "snps_in_gt_gaps_consensus")],
    )


def pipeline_concordance(calls: DataFrame) -> DataFrame:
    """(a, b, shared, same_allele, only_a, only_b) of every pair of pipelines over (sample, pos)."""
    side = lambda p: calls.select(F.col("pipeline").alias(p), "sample", "pos", F.col("alt").alias(f"{p}_alt"))
    both = side("a").join(side("b"), ["sample", "pos"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("a_alt") == F.col("b_alt")).alias("same_allele"))
    n = calls.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(F.col("pipeline").alias("a"), F.col("n").alias("na")).crossJoin(n.select(F.col("pipeline").alias("b"), F.col("n").alias("nb"))).where("a < b")
    z = F.coalesce("shared", F.lit(0))
    return grid.join(both, ["a", "b"], "left").select("a", "b", z.alias("shared"), F.coalesce("same_allele", F.lit(0)).alias("same_allele"), (F.col("na") - z).alias("only_a"), (F.col("nb") - z).alias("only_b"))


def filter_positions(calls: DataFrame, gaps: DataFrame, pipelines: list[str], n_samples: int, filters: list[str], any_of: bool = False, any_sample: bool = False) -> DataFrame:
    """Positions with a call in all samples of some pipeline that pass the filters (all, or any of them): the id of a
    pipeline, ``both``, ``consensus``, ``discord``, ``exclusive:<id>`` or ``gaps:<id>``.  With ``any_sample`` a call in
    one sample is enough."""
    least = 1 if any_sample else n_samples
    g = calls.groupBy("pos", "pipeline").agg((F.count_distinct("sample") >= least).alias("all"), F.count_distinct("alt").alias("alts"), F.min("alt").alias("alt"))
    wide = g.groupBy("pos").agg(*[F.max(F.when(F.col("pipeline") == p, F.col("all"))).alias(f"all_{p}") for p in pipelines], F.count_distinct(F.when(F.col("all") & (F.col("alts") == 1), F.col("alt"))).alias("kinds"), F.count_if("all").alias("n_all"))
    flags = {p: F.coalesce(f"all_{p}", F.lit(False)) for p in pipelines}
    for p in {f.split(":", 1)[1] for f in filters if f.startswith("gaps:")}:
        cover = iv.sweep(gaps.where(F.col("pipeline") == p).select("start", "end"), [])
        wide = iv.locate(wide, cover, [], []).withColumnRenamed("inside", f"gap_{p}")
    tests = []
    for f in filters:
        kind, _, p = f.partition(":")
        if kind == "gaps":
            tests.append(F.col(f"gap_{p}"))
        elif kind == "exclusive":
            tests.append(flags[p] & (F.col("n_all") == 1))
        elif kind == "both":
            tests.append(F.col("n_all") == len(pipelines))
        elif kind == "consensus":
            tests.append((F.col("n_all") == len(pipelines)) & (F.col("kinds") == 1))
        elif kind == "discord":
            tests.append((F.col("n_all") >= 1) & (F.col("n_all") < len(pipelines)))
        else:
            tests.append(flags[f])
    ok = F.lit(not any_of)
    for t in tests:
        ok = (ok | t) if any_of else (ok & t)
    return wide.where(F.col("n_all") >= 1).where(ok).select("pos", "n_all")


def region(calls: DataFrame, gaps: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """(kind, pipeline, sample, start, end, alt) of what lies in a region: calls inside it and gaps cut to it.  At
    most 10,000 positions long, 1,000 by default."""
    end = min(start + 1000 if end is None else end, start + 10_000)
    c = calls.where(F.col("pos").between(start, end)).select(F.lit("snp").alias("kind"), "pipeline", "sample", F.col("pos").alias("start"), F.col("pos").alias("end"), "alt")
    g = gaps.where((F.col("end") >= start) & (F.col("start") <= end)).select(F.lit("gap").alias("kind"), "pipeline", "sample", F.greatest("start", F.lit(start)).cast("long").alias("start"), F.least("end", F.lit(end)).cast("long").alias("end"), F.lit(None).cast("string").alias("alt"))
    return c.unionByName(g)


def global_stats(sites: DataFrame, gaps: DataFrame, calls: DataFrame, gt: str, n_samples: int, ref_len: int) -> DataFrame:
    """(pipeline, variant, usable_space, total_snps, consensus_snps, discriminating_snps, gap_affected, gt_consensus,
    majority_rule, confirmed, missing_calls): a missing call is a value of its own.

    strict leaves out positions gapped in any sample and looks at all samples, relaxed those gapped in all and
    looks at the others.  A majority needs three samples and exactly two values.  ``sites`` as from
    ``sites.site_table``, ``calls`` as from ``sites.snps``."""
    from gapweave.operators.sites import gap_sizes

    t = calls.where(F.col("pipeline") == gt).groupBy("pos").agg(F.count_distinct("alt").alias("t_alts"), F.count_distinct("sample").alias("t_n"))
    s = sites.join(t, "pos", "left")
    agree = (F.col("pipeline") != gt) & (F.col("t_n").isNull() | ((F.col("t_alts") == 1) & (F.col("t_n") == n_samples)))
    out = None
    for variant, cols, size in (("strict", "called", "gap_union"), ("relaxed", "carriers", "gap_intersect")):
        live = s.where("k = 0" if variant == "strict" else "k < n").withColumn("c", F.col(cols)).withColumn("a", F.col("n") - F.col("k"))
        counts = F.expr("transform(array_distinct(transform(c, x -> x.alt)), v -> size(filter(c, x -> x.alt = v)))")
        live = live.withColumn("w", counts).withColumn("none", (F.col("a") - F.size("c")).cast("int"))
        kinds = F.size("w") + F.when(F.col("none") > 0, 1).otherwise(0)
        most = F.greatest(F.coalesce(F.array_max("w"), F.lit(0)), F.col("none"))
        enough = F.col("a") >= 2 if variant == "relaxed" else F.lit(True)
        consensus = enough & (F.size("w") == 1) & (F.col("none") == 0)
        disc = enough & ~consensus & ((F.size("w") > 0) if variant == "relaxed" else F.lit(True))
        gapped = disc & (F.col("k") > 0)
        majority = (F.col("a") >= 3) & (most == F.col("a") - 1) & (kinds == 2)
        free = disc & ~gapped
        agg = live.groupBy("pipeline").agg(
            F.count(F.lit(1)).alias("total_snps"), F.count_if(consensus).alias("consensus_snps"), F.count_if(disc).alias("discriminating_snps"), F.count_if(gapped).alias("gap_affected"), F.count_if(free & agree).alias("gt_consensus"),
            F.count_if(free & ~agree & majority).alias("majority_rule"), F.count_if(free & ~agree & ~majority).alias("confirmed"), F.count_if(enough & (F.size("w") > 0) & (F.col("none") > 0)).alias("missing_calls"),
        )
        rows = agg.join(gap_sizes(gaps, n_samples), "pipeline", "left").withColumn("usable_space", (F.lit(ref_len) - F.coalesce(size, F.lit(0))).cast("long"))
        rows = rows.select("pipeline", F.lit(variant).alias("variant"), "usable_space", *[c for c in agg.columns if c != "pipeline"])
        out = rows if out is None else out.unionByName(rows)
    return out
