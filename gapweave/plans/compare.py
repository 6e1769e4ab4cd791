"""The comparison of pipelines from a project to a report of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import sites, truth
from gapweave.sources import sinks
from gapweave.sources.store import stored


class Comparison:
    """Answers over calls (pipeline, sample, pos 0-based, alt), gaps (pipeline, sample, start, end) and ref_base.  Of calls that repeat
    a position the last by n and i counts, where they have these columns; a pipeline in ``core`` is judged by its core alleles.

    ``coord_compat`` tests positions against 1-based gaps unshifted, as finished reports have it.  What only the report
    shows is optional: ``about`` (pipeline and what is known of it, as ``Config.pipeline_rows``), ``distances`` (pipeline, row,
    col, distance) of the pipelines' own matrices, ``warnings`` (text), and further columns of ``samples`` such as a label."""

    def __init__(self, calls: DataFrame, gaps: DataFrame, ref_base: DataFrame, samples: DataFrame, ref_len: int, truth_id: str | None = None, core: DataFrame | None = None, coord_compat: bool = True, about: DataFrame | None = None, distances: DataFrame | None = None, warnings: DataFrame | None = None):
        self.spark: SparkSession = calls.sparkSession
        self.ref_len, self.samples, self.truth_id, self.core = ref_len, samples, truth_id, core
        self.given_calls, self.given_gaps, self.ref_base = calls, gaps, ref_base
        self.distances, self.warnings = distances, warnings
        self.n = samples.count()
        order = [c for c in ("n", "i") if c in calls.columns]
        own = calls.select("pipeline", "sample", "pos", "alt", *order)
        if core is not None:
            # A pipeline with core alleles is judged by these alone.
            own = own.join(core.select("pipeline").distinct(), "pipeline", "left_anti").unionByName(sites.core_calls(core), allowMissingColumns=True)
        self.pipelines = own.select("pipeline").union(gaps.select("pipeline")).distinct()
        self.about = self.pipelines if about is None else about
        # All that follows reads these four; each is planned and written once.
        self.calls = stored(sites.snps(own, ref_base), "calls")
        self.gaps = stored(iv.merge(sites.shifted(gaps, coord_compat), ["pipeline", "sample"]), "gaps")
        self.cover = stored(iv.sweep(self.gaps, ["pipeline"]), "cover")
        self.core_table = None if core is None else stored(truth.core_table(core), "core")
        self.sites = stored(sites.site_table(self.calls, self.gaps, self.n, self.cover), "sites")

    def kpis(self) -> DataFrame:
        return sites.kpis(self.sites, self.gaps, self.pipelines, self.n, self.cover)

    def global_stats(self) -> DataFrame:
        return sites.global_stats(self.sites, self.gaps, self.pipelines, self.n, self.ref_len, self.cover)

    def pairs(self) -> DataFrame:
        return sites.pair_stats(self.sites, self.gaps, self.pipelines, self.samples, self.ref_len)

    def truth_results(self) -> DataFrame | None:
        """Against core alleles if there are some, else against calls; nothing for fewer than two samples."""
        if self.truth_id is None or self.n < 2:
            return None
        if self.core is None:
            return truth.calls_summary(self.sites, self.gaps, self.truth_id, self.samples, cover=self.cover)
        return truth.core_summary(self.details(), self.core, self.core_table)

    def breakdown(self) -> DataFrame | None:
        """Why the sites of each pipeline discriminate; nothing without a truth."""
        return None if self.truth_id is None else sites.breakdown(self.calls, self.sites, self.truth_id, self.n)

    def details(self) -> DataFrame:
        is_truth = F.col("pipeline") == self.truth_id
        return truth.core_details(self.sites.where(is_truth), self.gaps.where(is_truth), self.core, self.gaps.where(~is_truth), self.samples, self.cover, self.truth_id, self.core_table)

    def report(self) -> DataFrame:
        """One row: samples, pipelines, kpis, global_stats, pair_summary, per_sample and pairs as arrays of structs; truth,
        breakdown, distances and warnings where there are some.  Its size follows the pairs of samples, never calls or gaps.

        Each part that reads sites or gaps is planned and written by itself, so the driver never holds the plans and broadcasts of all."""
        rows = lambda d, name: d.groupBy().agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(name))
        kept = lambda d, name: None if d is None else stored(d, name)
        pairs = kept(self.pairs(), "pairs")
        parts = {"samples": self.samples, "pipelines": kept(self.about, "about"), "global_stats": kept(self.global_stats(), "global_stats"), "pair_summary": sites.pair_summary(pairs), "per_sample": sites.per_sample_pairs(pairs), "pairs": pairs}
        parts |= {"truth": kept(self.truth_results(), "truth"), "breakdown": kept(self.breakdown(), "breakdown"), "distances": self.distances}
        out = rows(kept(self.kpis(), "kpis"), "kpis")
        for name, d in parts.items():
            if d is not None:
                out = out.crossJoin(rows(d, name))
        if self.warnings is not None:
            out = out.crossJoin(self.warnings.groupBy().agg(F.sort_array(F.collect_list("text")).alias("warnings")))
        return out.withColumn("ref_length", F.lit(self.ref_len)).withColumn("schema_version", F.lit("2.0"))

    def data(self) -> DataFrame:
        """(sample, pipeline, kind, start, end, ref, alt, qual, dp, n, i) a row for each call (``snp``) and gap as they were given;
        calls move to 1-based positions, gaps stay as in their files.  What the calls lack is null."""
        have = lambda c, kind: (F.col(c) if c in self.given_calls.columns else F.lit(None)).cast(kind).alias(c)
        own = ("sample", "pipeline")
        pos = (F.col("pos") + 1).cast("long")
        snps = self.given_calls.select(*own, F.lit("snp").alias("kind"), pos.alias("start"), (pos + 1).alias("end"), have("ref", "string"), have("alt", "string"), have("qual", "double"), have("dp", "long"), have("n", "long"), have("i", "int"))
        gaps = self.given_gaps.select(*own, F.lit("gap").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        return snps.unionByName(gaps, allowMissingColumns=True)

    def write(self, path: str, dashboard: bool = False) -> None:
        """The report as JSON at ``path``, and beside it at ``<path>.data`` a line of JSON for each call and gap, sorted over as
        many files as there are partitions, and at ``<path>.reference`` the reference in chunks; a dashboard leaves these out.
        ``report.written`` reads all three."""
        sinks.report_json(self.report(), path)
        if not dashboard:
            chunk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
            self.ref_base.groupBy(F.expr("pos div 65536").alias("k")).agg(F.min("pos").alias("start"), chunk.alias("bases")).drop("k").write.mode("overwrite").json(f"{path}.reference")
            order = ("sample", "pipeline", "kind", "start", "end")
            self.data().repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path}.data")
