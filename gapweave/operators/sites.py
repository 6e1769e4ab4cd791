"""Sites, their classification, and pair statistics from sparse calls.

A sample without a call has the reference base, so a site is decided by its carriers, the number of
gapped samples and the number of samples.  The sites-by-samples matrix is never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv

STRATEGIES = ("gap_union", "gap_intersect")


def core_calls(core: DataFrame) -> DataFrame:
    """The calls that a core-allele table stands for: (pipeline, sample, pos, alt, and n and i where it has them) of the
    alleles that are neither a gap nor N."""
    order = [c for c in ("n", "i") if c in core.columns]
    return core.where(~F.substring("allele", 1, 1).isin("-", "N")).select("pipeline", "sample", "pos", F.col("allele").alias("alt"), *order)


def last_calls(calls: DataFrame, keys: tuple[str, ...] = ("pipeline", "sample", "pos")) -> DataFrame:
    """One call for each key, the last one written: by ``n`` (the line) and ``i`` (the place in an MNP), as the readers of
    calls give them, where the calls have these columns.  Calls that are equal in them, or have none, go by their alt.

    A maximum of structs, so repeats meet in partial aggregates."""
    order = [c for c in ("n", "i") if c in calls.columns] + ["alt"]
    rest = [c for c in calls.columns if c not in keys and c not in order]
    last = calls.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in calls.columns])


#: Bits of the place in an MNP, and of a letter, in the order of calls.
_PLACE, _LETTER = 1 << 31, 256


def snps(calls: DataFrame, ref_base: DataFrame) -> DataFrame:
    """(pipeline, sample, pos, alt, base) of the calls whose alt (its first character) differs from the reference base.  Positions
    outside the reference drop out.  Comparison is byte-exact.  Of the calls of a pipeline and sample that are left at a position
    the last one counts, as in ``last_calls``.

    Line, place and letter are one number, so its maximum is kept in a hash table and nothing is sorted; letters are of one
    byte."""
    letter = lambda c: F.ascii(c)
    alt = F.coalesce(F.nullif(F.substring("alt", 1, 1), F.lit("")), F.lit("N"))
    c = calls.select("pipeline", "sample", "pos", alt.alias("alt"), *[x for x in ("n", "i") if x in calls.columns])
    hit = c.join(ref_base.select("pos", "base"), "pos").where("alt != base")
    order = letter("alt").cast("long")
    if "i" in calls.columns:
        order = order + F.coalesce("i", F.lit(0)).cast("long") * _LETTER
    if "n" in calls.columns:
        order = F.coalesce("n", F.lit(0)).cast("decimal(20,0)") * F.lit(_PLACE * _LETTER).cast("decimal(13,0)") + order.cast("decimal(20,0)")
    last = hit.groupBy("pipeline", "sample", "pos").agg(F.max(order).alias("_o"), F.max(letter("base")).alias("_b"))
    return last.select("pipeline", "sample", "pos", F.char((F.col("_o") % _LETTER).cast("long")).alias("alt"), F.char(F.col("_b").cast("long")).alias("base"))


def shifted(gaps: DataFrame, coord_compat: bool) -> DataFrame:
    """Gaps to test 0-based positions against.  With ``coord_compat`` 1-based gaps are taken as they
    are, one too far right, as the flagship statistics do; else they move to 0-based."""
    return gaps if coord_compat else gaps.withColumn("start", F.col("start") - 1).withColumn("end", F.col("end") - 1)


def cover_of(gaps: DataFrame, cover: DataFrame | None) -> DataFrame:
    """(pipeline, start, end, k) of merged gaps; a table that is already there is taken instead."""
    return iv.sweep(gaps, ["pipeline"]) if cover is None else cover


def site_table(calls: DataFrame, gaps: DataFrame, n_samples: int, cover: DataFrame | None = None) -> DataFrame:
    """A row per (pipeline, pos) with a non-reference call: base, called array<struct<sample,alt>>, those of
    them that are not gapped as carriers, and k, the number of samples gapped there.

    ``calls`` as from ``snps``; ``gaps`` merged per pipeline and sample."""
    marked = iv.locate(calls.select("pipeline", "sample", "pos", "alt", "base"), gaps, ["pipeline", "sample"], [])
    sites = marked.groupBy("pipeline", "pos").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.struct("sample", "alt", "inside"))).alias("all"))
    plain = lambda rows: F.transform(rows, lambda c: F.struct(c["sample"].alias("sample"), c["alt"].alias("alt")))
    sites = sites.select("pipeline", "pos", "base", plain(F.filter("all", lambda c: ~c["inside"])).alias("carriers"), plain("all").alias("called"))
    out = iv.locate(sites, cover_of(gaps, cover), ["pipeline"], ["k"])
    return out.select("pipeline", "pos", "base", "carriers", "called", F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.lit(n_samples).cast("long").alias("n"))


def classified(sites: DataFrame) -> DataFrame:
    """Adds present, alleles (different ones among present samples), consensus and disc."""
    present = F.col("n") - F.col("k")
    alts = F.size(F.array_distinct(F.transform("carriers", lambda c: c["alt"])))
    alleles = alts + F.when(present > F.size("carriers"), 1).otherwise(0)
    out = sites.withColumn("present", present).withColumn("n_alleles", alleles)
    return out.withColumn("disc", (F.col("present") >= 2) & (F.col("n_alleles") >= 2)).withColumn("consensus", (F.col("present") >= 2) & (F.col("n_alleles") == 1) & (F.size("carriers") > 0))


def excluded(strategy: str):
    return F.col("k") >= 1 if strategy == "gap_union" else F.col("k") == F.col("n")


def gap_sizes(gaps: DataFrame, n_samples: int, cover: DataFrame | None = None) -> DataFrame:
    """(pipeline, gap_union, gap_intersect): positions gapped in any and in all samples."""
    size = F.col("end") - F.col("start")
    return cover_of(gaps, cover).groupBy("pipeline").agg(F.sum(size).alias("gap_union"), F.coalesce(F.sum(F.when(F.col("k") == n_samples, size)), F.lit(0)).alias("gap_intersect"))


def global_stats(sites: DataFrame, gaps: DataFrame, pipelines: DataFrame, n_samples: int, ref_len: int, cover: DataFrame | None = None) -> DataFrame:
    """(pipeline, strategy, usable_space, total_snps, consensus_snps, disc_snps, missing_vcf)."""
    live = {s: ~excluded(s) for s in STRATEGIES}
    names = ("total_snps", "consensus_snps", "disc_snps", "missing_vcf")
    tests = (F.lit(True), F.col("consensus"), F.col("disc"), F.col("k") > 0)
    agg = classified(sites).groupBy("pipeline").agg(*[F.count_if(live[s] & t).alias(f"{s}_{c}") for s in STRATEGIES for c, t in zip(names, tests, strict=True)])
    rows = pipelines.join(agg, "pipeline", "left").join(gap_sizes(gaps, n_samples, cover), "pipeline", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    each = [F.struct(F.lit(s).alias("strategy"), (F.lit(ref_len) - zero(s)).cast("long").alias("usable_space"), *[zero(f"{s}_{c}").alias(c) for c in names]) for s in STRATEGIES]
    return rows.select("pipeline", F.inline(F.array(*each)))


def kpis(sites: DataFrame, gaps: DataFrame, pipelines: DataFrame, n_samples: int, cover: DataFrame | None = None) -> DataFrame:
    """(pipeline, n_sites, gap_positions, core_snps): core is discriminating under gap union."""
    c = classified(sites).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if((F.col("k") == 0) & F.col("disc")).alias("core_snps"))
    g = gap_sizes(gaps, n_samples, cover).select("pipeline", F.col("gap_union").alias("gap_positions"))
    out = pipelines.join(c, "pipeline", "left").join(g, "pipeline", "left")
    return out.select("pipeline", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n_sites", "gap_positions", "core_snps")])


def breakdown(calls: DataFrame, sites: DataFrame, gt: str, n_samples: int) -> DataFrame:
    """(pipeline, gap_affected, gt_consensus, majority_rule, confirmed) of sites discriminating under gap
    union.  gap_affected is 0 by construction, as gapped positions are left out first."""
    mine = classified(sites).where((F.col("pipeline") != gt) & (F.col("k") == 0) & F.col("disc"))
    truth = calls.where(F.col("pipeline") == gt).groupBy("pos").agg(F.count_distinct("alt").alias("t_alts"), F.count_distinct("sample").alias("t_carriers"))
    same = F.col("t_alts").isNull() | ((F.col("t_alts") == 1) & (F.col("t_carriers") == n_samples))
    counts = F.expr("array_append(transform(array_distinct(transform(carriers, c -> c.alt)), a -> size(filter(carriers, c -> c.alt = a))), CAST(present - size(carriers) AS INT))")
    majority = F.array_max(counts) == F.col("present") - 1
    flag = F.when(same, "gt_consensus").when(majority, "majority_rule").otherwise("confirmed")
    out = mine.join(truth, "pos", "left").select("pipeline", flag.alias("f")).groupBy("pipeline")
    return out.agg(F.lit(0).cast("long").alias("gap_affected"), *[F.count_if(F.col("f") == x).alias(x) for x in ("gt_consensus", "majority_rule", "confirmed")])


def gapped_samples(sites: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds ``gapped``: the sorted set of samples gapped at the site."""
    hit = iv.locate(sites.where("k > 0").select("pipeline", "pos"), gaps, ["pipeline"], ["sample"]).where("inside")
    sets = hit.groupBy("pipeline", "pos").agg(F.array_sort(F.collect_set("sample")).alias("gapped"))
    return sites.join(sets, ["pipeline", "pos"], "left").withColumn("gapped", F.coalesce("gapped", F.array().cast("array<string>")))


def pair_excess(sites: DataFrame, gaps: DataFrame) -> DataFrame:
    """(pipeline, a, b, excess): by how much the carrier counts of two samples together exceed the sites at which they
    differ.  Two carriers of one alt count twice too often, two of different alts once, a carrier beside a
    gapped sample once; so only carriers meet carriers and gapped samples, never the samples without a call."""
    rest = F.slice("carriers", F.col("i") + 2, F.size("carriers"))
    both = sites.select("pipeline", "carriers", F.posexplode("carriers").alias("i", "x")).select("pipeline", "x", F.explode(rest).alias("y"))
    both = both.select("pipeline", F.col("x.sample").alias("a"), F.col("y.sample").alias("b"), F.when(F.col("x.alt") == F.col("y.alt"), 2).otherwise(1).alias("w"))
    gapped = iv.locate(sites.where("k > 0 AND size(carriers) > 0").select("pipeline", "pos", "carriers"), gaps, ["pipeline"], ["sample"]).where("inside")
    beside = gapped.select("pipeline", F.explode("carriers").alias("x"), "sample").select("pipeline", F.least("x.sample", "sample").alias("a"), F.greatest("x.sample", "sample").alias("b"), F.lit(1).alias("w"))
    return both.unionByName(beside).groupBy("pipeline", "a", "b").agg(F.sum("w").alias("excess"))


def pair_stats(sites: DataFrame, gaps: DataFrame, pipelines: DataFrame, samples: DataFrame, ref_len: int) -> DataFrame:
    """(pipeline, a, b, usable_space, disc_snps) of every sample pair a < b: positions gapped in neither, and
    sites among them whose alleles differ."""
    own = gaps.groupBy("pipeline", "sample").agg(F.sum(F.col("end") - F.col("start")).alias("own"))
    carried = sites.select("pipeline", F.explode("carriers.sample").alias("sample")).groupBy("pipeline", "sample").agg(F.count(F.lit(1)).alias("sites"))
    each = samples.crossJoin(F.broadcast(pipelines)).join(own, ["pipeline", "sample"], "left").join(carried, ["pipeline", "sample"], "left").na.fill(0, ["own", "sites"])
    side = lambda c: each.select("pipeline", F.col("sample").alias(c), F.col("own").alias(f"own_{c}"), F.col("sites").alias(f"sites_{c}"))
    grid = side("a").join(side("b"), "pipeline").where("a < b")
    out = grid.join(iv.pair_overlaps(gaps, ["pipeline"], "sample"), ["pipeline", "a", "b"], "left").join(pair_excess(sites, gaps), ["pipeline", "a", "b"], "left").na.fill(0, ["shared", "excess"])
    usable = F.lit(ref_len) - F.col("own_a") - F.col("own_b") + F.col("shared")
    return out.select("pipeline", "a", "b", usable.cast("long").alias("usable_space"), (F.col("sites_a") + F.col("sites_b") - F.col("excess")).cast("long").alias("disc_snps"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Exact minimum, maximum, mean and median of discriminating SNPs, and mean usable space."""
    return pairs.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("num_pairs"), F.min("disc_snps").alias("disc_min"), F.max("disc_snps").alias("disc_max"), F.avg("disc_snps").alias("disc_avg"), F.median("disc_snps").alias("disc_median"), F.avg("usable_space").alias("usable_avg")
    )


def per_sample_pairs(pairs: DataFrame) -> DataFrame:
    both = pairs.select("pipeline", F.explode(F.array("a", "b")).alias("sample"), "usable_space", "disc_snps")
    return both.groupBy("pipeline", "sample").agg(F.avg("usable_space").alias("avg_usable_space"), F.avg("disc_snps").alias("avg_disc_snps"), F.count(F.lit(1)).alias("num_pairs"))
