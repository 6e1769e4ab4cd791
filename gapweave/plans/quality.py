"""Quality control of samples from gaps, contigs and alignments to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import alignments, qc, viewer
from gapweave.sources import sinks
from gapweave.sources.store import stored


class Quality:
    """Answers over gaps (sample, start, end), contigs (sample, contig, length) and alignments (sample, identity,
    sample_coverage, reference_coverage), one row a sample, of assemblies or of ``alignments.reads_as_alignments``.  ``samples`` may name more
    samples than are aligned: those take part in pairs and impact but have no score."""

    def __init__(self, gaps: DataFrame, contigs: DataFrame, aligned: DataFrame, ref_name: str, ref_len: int, min_identity: float = 0.95, samples: DataFrame | None = None):
        self.ref_name, self.ref_len, self.aligned = ref_name, ref_len, aligned
        self.samples = aligned.select("sample").distinct() if samples is None else samples
        self.n = self.samples.count()
        self.one = gaps.sparkSession.createDataFrame([(0,)], "x int").select()  # one row for all, without a key
        self.gaps = stored(iv.merge(gaps, ["sample"]), "gaps")
        self.pairs = stored(qc.pairwise_gaps(self.gaps, self.samples, [], ref_len), "pairs")
        self.pair_metrics = stored(qc.pair_metrics(self.pairs, self.samples, []), "metrics")
        a = aligned.select("sample", F.col("identity").alias("ref_identity"), F.col("reference_coverage").alias("ref_coverage"))
        m = a.join(self.pair_metrics, "sample").join(qc.n50(contigs), "sample", "left").na.fill(0, ["n_contigs", "total_length", "n50"])
        self.scored = stored(qc.score(m.select("sample", "ref_identity", "ref_coverage", "avg_quality", "n50", "total_length", "total_unique", "n_contigs"), min_identity), "scored")

    def reference(self) -> DataFrame:
        """(reference_name, reference_length, avg_identity, avg_sample_coverage, avg_reference_coverage)."""
        return alignments.averages(self.aligned).select(F.lit(self.ref_name).alias("reference_name"), F.lit(self.ref_len).cast("long").alias("reference_length"), "*")

    def impact(self) -> DataFrame:
        return qc.impact(self.gaps, self.samples, self.pair_metrics, self.ref_len)

    def empty_regions(self) -> DataFrame:
        """(threshold, min_samples, start, end) of all thresholds; not in the report, as there may be many."""
        return qc.empty_regions(self.gaps, self.one, [], self.n)

    def thresholds(self) -> DataFrame:
        return qc.threshold_summary(self.empty_regions(), self.one, [], self.n, self.ref_len)

    def histogram(self) -> DataFrame:
        """(covered, positions, position_pct): how many positions each number of samples covers."""
        h = qc.full_histogram(self.gaps, self.one, [], self.n, self.ref_len)
        return h.withColumn("position_pct", F.col("positions") / self.ref_len * 100)

    def fragile(self) -> DataFrame:
        return qc.fragile_regions(self.gaps, [], self.n)

    def outliers(self) -> DataFrame:
        mean = qc.dataset_quality(self.pairs, []).select("mean_quality")
        return qc.outliers(self.scored.select("sample", "ref_coverage", "avg_quality").crossJoin(F.broadcast(mean)))

    def warnings(self) -> DataFrame:
        return viewer.warnings(self.scored, self.outliers(), qc.dataset_quality(self.pairs, []))

    def lines(self) -> DataFrame:
        return sinks.quality_report(self.scored, self.pairs, self.reference(), self.samples)

    def report(self) -> DataFrame:
        """One row: summary, reference, samples, pairs, impact, outliers, warnings, thresholds, histogram and fragile regions as arrays
        of structs."""
        rows = lambda d, name: d.groupBy().agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(name))
        out = rows(qc.summary(self.scored), "summary")
        parts = {"reference": self.reference(), "samples": self.scored, "pairs": self.pairs, "impact": self.impact(), "outliers": self.outliers(), "warnings": self.warnings(), "thresholds": self.thresholds(), "histogram": self.histogram(), "fragile": self.fragile()}
        for name, d in parts.items():
            out = out.crossJoin(rows(d, name))
        return out

    def write(self, path: str) -> None:
        sinks.write_quality(self.lines(), self.report(), path)
