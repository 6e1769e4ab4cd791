"""Comparison of pipelines with a ground-truth pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators.sites import STRATEGIES, gapped_samples


def truth_discs(gt_sites: DataFrame) -> DataFrame:
    """Sites of the ground truth where samples differ, a row for each ``strategy`` under which they do; a missing call is
    a value of its own here.

    Under gap_union no sample is gapped; under gap_intersect gapped samples are left out and two must remain."""
    active = F.col("n") - F.col("k")
    same = (F.size("carriers") == 0) | ((F.size("carriers") == active) & (F.size(F.array_distinct(F.transform("carriers", lambda c: c["alt"]))) == 1))
    live = {"gap_union": F.col("k") == 0, "gap_intersect": (F.col("k") < F.col("n")) & (active >= 2)}
    return gt_sites.withColumn("strategy", F.explode(F.array_compact(F.array(*[F.when(live[s] & ~same, s) for s in STRATEGIES]))))


def truth_disc(gt_sites: DataFrame, strategy: str) -> DataFrame:
    return truth_discs(gt_sites).where(F.col("strategy") == strategy).drop("strategy")


def _active(everyone: Column) -> Column:
    """The samples that a strategy looks at."""
    return F.when(F.col("strategy") == "gap_union", everyone).otherwise(F.array_except(everyone, F.col("gapped")))


def core_table(core: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(pipeline, pos, m map<sample, first character>, core_disc, lines) of a core-allele table: disc if two valid
    alleles (neither N nor -) differ.  With ``samples`` the map holds those only.

    A position may stand on several lines (two contigs, a repeated line): ``lines`` counts them, the map is that of the last,
    and one line with different alleles makes the position discriminating.  Lines are told apart by ``n``, else by ``chrom``,
    where the table has such a column; of a sample named twice on a line the last column ``i`` counts, else the greatest allele."""
    line = next((F.col(c) for c in ("n", "chrom") if c in core.columns), None)
    fields = ["sample", "allele"]
    if samples is not None:
        core = core.join(samples.select("sample", F.lit(True).alias("known")), "sample", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        fields.append("known")
    order = ([line.alias("n")] if line is not None else []) + (["i"] if "i" in core.columns else [])
    table = core.groupBy("pipeline", "pos").agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("rows"))
    valid = lambda rs: F.filter(rs, lambda r: ~r["allele"].isin("N", "-"))
    differ = lambda rs: F.size(F.array_distinct(F.transform(valid(rs), lambda r: r["allele"]))) > 1
    if line is None:
        table = table.withColumn("lines", F.lit(1)).withColumn("core_disc", differ("rows"))
    else:
        table = table.withColumn("ns", F.array_distinct(F.col("rows.n"))).withColumn("lines", F.size("ns"))
        table = table.withColumn("core_disc", F.when(F.col("lines") == 1, differ("rows")).otherwise(F.exists("ns", lambda n: differ(F.filter("rows", lambda r: r["n"] == n)))))
        table = table.withColumn("rows", F.when(F.col("lines") == 1, F.col("rows")).otherwise(F.filter("rows", lambda r: r["n"] == F.array_max("ns"))))
    last = F.col("rows") if samples is None else F.filter("rows", lambda r: r["known"])
    table = table.withColumn("last", F.transform(last, lambda r: F.struct(r["sample"].alias("s"), F.substring(r["allele"], 1, 1).alias("a"))))
    names = F.array_distinct(F.col("last.s"))
    # The rows are sorted, so the last entry of a repeated sample counts.
    repeated = F.map_from_arrays(names, F.transform(names, lambda s: F.element_at(F.filter("last", lambda r: r["s"] == s), -1)["a"]))
    m = F.when(F.size(names) == F.size("last"), F.map_from_entries("last")).otherwise(repeated)
    return table.select("pipeline", "pos", m.alias("m"), "core_disc", F.col("lines").cast("long").alias("lines"))


def _agrees(names: Column, theirs: str, mine: str) -> Column:
    """Whether every named sample has the same allele in both maps; missing ones have the base."""
    return F.expr(f"forall({names}, s -> coalesce(try_element_at({theirs}, s), base) = coalesce(try_element_at({mine}, s), base))")


def core_details(gt_sites: DataFrame, gt_gaps: DataFrame, core: DataFrame, pl_gaps: DataFrame, samples: DataFrame, cover: DataFrame | None = None, gt: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """(pipeline, strategy, pos, status): every discriminating position of the truth as concordant,
    discordant, not_disc_in_pl, in_pl_gap or lost, and the pipeline's own as in_gt_gap or pl_only.

    ``cover`` of all pipelines, with the name ``gt`` of the truth, saves sweeping the gaps again, ``table`` the core table."""
    names = [r[0] for r in samples.orderBy("sample").collect()]
    n = len(names)
    everyone = F.array(*[F.lit(x) for x in names])
    table = core_table(core) if table is None else table
    pipelines = table.select("pipeline").distinct()
    if cover is None:
        pl_any, gt_cover = iv.sweep(pl_gaps, ["pipeline"]), iv.sweep(gt_gaps.select("start", "end"), [])
    else:
        pl_any, gt_cover = cover, cover.where(F.col("pipeline") == gt).select("start", "end", "k")
    marked = gapped_samples(gt_sites, gt_gaps)
    core_disc = iv.locate(table.where("core_disc").select("pipeline", "pos"), gt_cover, [], ["k"]).select("pipeline", "pos", F.coalesce("k", F.lit(0)).alias("gk"))
    disc = truth_discs(marked)
    t = disc.select("strategy", "pos", "base", F.map_from_entries("called").alias("g"), _active(everyone).alias("active")).crossJoin(F.broadcast(pipelines))
    t = iv.locate(t.join(table, ["pipeline", "pos"], "left"), pl_any, ["pipeline"], [])
    status = (
        F.when(F.col("m").isNull() & F.col("inside"), "in_pl_gap")
        .when(F.col("m").isNull(), "lost")
        .when(~F.col("core_disc"), "not_disc_in_pl")
        .when(_agrees("active", "g", "m"), "concordant")
        .otherwise("discordant")
    )
    first = t.select("pipeline", "strategy", "pos", status.alias("status"))
    gapped = {"gap_union": F.col("gk") >= 1, "gap_intersect": F.col("gk") == n}
    rest = core_disc.select("pipeline", "pos", F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), gapped[s].alias("g")) for s in STRATEGIES])))
    own = rest.where("g").select("pipeline", "strategy", "pos", F.lit("in_gt_gap").alias("status"))
    only = rest.where("NOT g").join(disc.select("strategy", "pos"), ["strategy", "pos"], "left_anti").select("pipeline", "strategy", "pos", F.lit("pl_only").alias("status"))
    return first.unionByName(own).unionByName(only)


def core_summary(details: DataFrame, core: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(pipeline, strategy, pl_total_core_snps, pl_disc, gt_disc, same_pos, concordant, pl_snps_in_gt_gaps)."""
    size = (core_table(core) if table is None else table).groupBy("pipeline").agg(F.sum("lines").alias("pl_total_core_snps"), F.count_if("core_disc").alias("pl_disc"))
    is_ = F.col("status")
    agg = details.groupBy("pipeline", "strategy").agg(
        F.count_if(~is_.isin("in_gt_gap", "pl_only")).alias("gt_disc"),
        F.count_if(is_.isin("concordant", "discordant")).alias("same_pos"),
        F.count_if(is_ == "concordant").alias("concordant"),
        F.count_if(is_ == "in_gt_gap").alias("pl_snps_in_gt_gaps"),
    )
    return size.join(agg, "pipeline")


def _differing(alts, plain) -> Column:
    """How many pairs differ among the carriers with these alts and ``plain`` samples without a call."""
    square = lambda c: c.cast("long") * c.cast("long")
    like = F.aggregate(F.array_distinct(alts), F.lit(0).cast("long"), lambda t, x: t + square(F.size(F.filter(alts, lambda y: y == x))))
    return ((square(F.size(alts) + plain) - square(plain) - like) / 2).cast("long")


def _paired_sites(gt_sites: DataFrame, gt_gaps: DataFrame) -> DataFrame:
    """(pos, base, carriers, plain, out): ``plain`` is the number of ungapped samples without a call, ``out`` names the
    carriers and the gapped ones, which are none of them."""
    s = gapped_samples(gt_sites, gt_gaps)
    plain = F.col("n") - F.col("k") - F.size("carriers")
    return s.select("pos", "base", "carriers", plain.alias("plain"), F.array_union(F.transform("carriers", lambda c: c["sample"]), F.col("gapped")).alias("out"))


def _alts(condition) -> Column:
    return F.transform(F.filter("carriers", condition), lambda c: c["alt"])


def _means(pipelines: DataFrame, hit: DataFrame, gt_sites: DataFrame, n: int) -> DataFrame:
    """The means over all pairs from ``hit`` (pipeline, s, c) and the pairs that differ at the sites of the truth."""
    plain = F.col("n") - F.col("k") - F.size("carriers")
    total = gt_sites.agg(F.sum(_differing(F.transform("carriers", lambda c: c["alt"]), plain)).alias("d"))
    out = pipelines.distinct().join(hit, "pipeline", "left").crossJoin(F.broadcast(total))
    z = lambda c: F.coalesce(c, F.lit(0)) / max(1, n * (n - 1) // 2)
    return out.select("pipeline", F.lit(n * (n - 1) // 2).cast("long").alias("num_pairs"), z("d").alias("gt_disc_avg"), z("s").alias("same_pos_avg"), z("c").alias("concordant_avg"))


def core_pairs(gt_sites: DataFrame, gt_gaps: DataFrame, core: DataFrame, samples: DataFrame) -> DataFrame:
    """(pipeline, num_pairs, gt_disc_avg, same_pos_avg, concordant_avg): means over all sample pairs.

    No pair is made: at each site the pairs that differ follow from the numbers of samples with each allele, those that
    agree with the core as well from the same numbers over the samples that agree."""
    core_disc = core_table(core, samples).where("core_disc").select("pipeline", "pos", "m")
    j = _paired_sites(gt_sites, gt_gaps).join(core_disc, "pos")
    theirs = lambda x: F.coalesce(F.try_element_at("m", x), F.col("base"))
    off = F.size(F.filter(F.array_except(F.map_keys("m"), F.col("out")), lambda x: theirs(x) != F.col("base")))
    good = _differing(_alts(lambda c: c["alt"] == theirs(c["sample"])), F.col("plain") - off)
    hit = j.groupBy("pipeline").agg(F.sum(_differing(_alts(lambda c: F.lit(True)), F.col("plain"))).alias("s"), F.sum(good).alias("c"))
    return _means(core.select("pipeline"), hit, gt_sites, samples.count())


def calls_summary(sites: DataFrame, gaps: DataFrame, gt: str, samples: DataFrame, pl_gaps: bool = True, cover: DataFrame | None = None) -> DataFrame:
    """The comparison by calls, for pipelines without core alleles: (pipeline, strategy, pl_total_core_snps,
    pl_disc, gt_disc, same_pos, concordant, pl_snps_in_gt_gaps).

    same_pos: an active sample has a pipeline call; concordant: no active sample is gapped in the pipeline
    either, and all alleles agree.  In-gap counts cover all sites of the pipeline.  pl_disc leaves out the
    pipeline's own gapped samples; without ``pl_gaps``, as the first reader version has it, it looks at all samples."""
    names = [r[0] for r in samples.orderBy("sample").collect()]
    n = len(names)
    everyone = F.array(*[F.lit(x) for x in names])
    marked = gapped_samples(sites, gaps)
    theirs = sites.where(F.col("pipeline") != gt)
    mine = marked.where(F.col("pipeline") != gt).select("pipeline", "pos", F.map_from_entries("called").alias("m"), "gapped")
    pipelines = theirs.select("pipeline").distinct()
    if pl_gaps:
        disc = truth_disc(theirs, "gap_intersect")
    else:
        disc = theirs.where((F.size("called") < n) | (F.size(F.array_distinct("called.alt")) > 1))
    disc = disc.groupBy("pipeline").agg(F.count(F.lit(1)).alias("pl_disc"))
    gt_cover = iv.sweep(gaps.where(F.col("pipeline") == gt).select("start", "end"), []) if cover is None else cover.where(F.col("pipeline") == gt).select("start", "end", "k")
    t = truth_discs(marked.where(F.col("pipeline") == gt))
    t = t.select("strategy", "pos", "base", F.map_from_entries("called").alias("g"), _active(everyone).alias("active")).crossJoin(F.broadcast(pipelines))
    j = t.join(mine, ["pipeline", "pos"], "left").withColumn("same", F.expr("m IS NOT NULL AND exists(active, s -> map_contains_key(m, s))"))
    good = F.col("same") & F.expr("NOT arrays_overlap(active, gapped)") & _agrees("active", "g", "m")
    agg = j.groupBy("pipeline", "strategy").agg(F.count(F.lit(1)).alias("gt_disc"), F.count_if("same").alias("same_pos"), F.count_if(good).alias("concordant"))
    k = F.coalesce("k", F.lit(0))
    total = iv.locate(theirs.select("pipeline", "pos"), gt_cover, [], ["k"]).groupBy("pipeline").agg(F.count(F.lit(1)).alias("pl_total_core_snps"), F.count_if(k >= 1).alias("gap_union"), F.count_if(k == n).alias("gap_intersect"))
    total = total.select("pipeline", "pl_total_core_snps", F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("pl_snps_in_gt_gaps")) for s in STRATEGIES])))
    rows = total.join(disc, "pipeline", "left").join(agg, ["pipeline", "strategy"], "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("pipeline", "strategy", *map(z, ("pl_total_core_snps", "pl_disc", "gt_disc", "same_pos", "concordant", "pl_snps_in_gt_gaps")))


def calls_pairs(sites: DataFrame, gaps: DataFrame, gt: str, samples: DataFrame) -> DataFrame:
    """Means over sample pairs for the comparison by calls: (pipeline, num_pairs, gt_disc_avg, same_pos_avg,
    concordant_avg).

    Counted as in ``core_pairs``; pairs of which the pipeline calls neither sample are taken off."""
    is_gt = F.col("pipeline") == gt
    mine = gapped_samples(sites.where(~is_gt), gaps.where(~is_gt)).select("pipeline", "pos", F.map_from_entries("called").alias("m"), F.col("gapped").alias("theirs"))
    j = _paired_sites(sites.where(is_gt), gaps.where(is_gt)).join(mine, "pos")
    called = lambda x: F.map_contains_key("m", x)
    free = lambda x: ~F.array_contains("theirs", x)
    agrees = lambda alt, x: alt == F.coalesce(F.try_element_at("m", x), F.col("base"))
    plain, base = F.col("plain"), F.col("base")
    named = F.array_except(F.map_keys("m"), F.col("out"))
    bound = F.array_except(F.array_union(F.map_keys("m"), F.col("theirs")), F.col("out"))
    off = F.size(F.filter(bound, lambda x: ~free(x) | ~agrees(base, x)))
    same = _differing(_alts(lambda c: F.lit(True)), plain) - _differing(_alts(lambda c: ~called(c["sample"])), plain - F.size(named))
    good = lambda c: free(c["sample"]) & agrees(c["alt"], c["sample"])
    both = _differing(_alts(good), plain - off) - _differing(_alts(lambda c: good(c) & ~called(c["sample"])), plain - F.size(bound))
    hit = j.groupBy("pipeline").agg(F.sum(same).alias("s"), F.sum(both).alias("c"))
    return _means(sites.where(~is_gt).select("pipeline"), hit, sites.where(is_gt), samples.count())
