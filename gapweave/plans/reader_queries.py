"""Queries of the reader's statistics and lookups, of distances with filters, summaries and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.functions import variants as va
from gapweave.operators import alignments, callsets, distances, reader, reader_v1, sites, truth, viewer
from gapweave.plans import queries as core
from gapweave.plans import text_queries as lines
from gapweave.plans.quality import Quality
from gapweave.plans.views import Views, oracle
from gapweave.sources import text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *ctes: str, plain: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        ORACLES[name] = sql if plain else oracle(sql, *ctes)
        return f

    return add


def stats(v):
    return reader.per_sample_stats(core.snps(v), core.merged(v), v.samples(), core.pipelines(v), "gt")


def pairs(v):
    return sites.pair_stats(core.stored_sites(v), core.merged(v), core.pipelines(v), v.samples(), v.ref_len)


# Totals, pairs and the truth as the first reader version has them

PAIR = """pd AS (SELECT p.pipeline, x.sample AS a, y.sample AS b,
  (SELECT n FROM n) - (SELECT count(DISTINCT g.pos) FROM gp g WHERE g.pipeline = p.pipeline AND g.sample IN (x.sample, y.sample)) AS usable,
  (SELECT count(*) FROM (SELECT DISTINCT pos FROM snp s WHERE s.pipeline = p.pipeline AND s.sample IN (x.sample, y.sample)) q
    LEFT JOIN snp i ON i.pipeline = p.pipeline AND i.sample = x.sample AND i.pos = q.pos LEFT JOIN snp j ON j.pipeline = p.pipeline AND j.sample = y.sample AND j.pos = q.pos
    WHERE i.alt IS DISTINCT FROM j.alt AND NOT EXISTS (SELECT 1 FROM gp g WHERE g.pipeline = p.pipeline AND g.sample IN (x.sample, y.sample) AND g.pos = q.pos)) AS disc
  FROM pipe p CROSS JOIN smp x JOIN smp y ON x.sample < y.sample)"""


@query(
    "v1_kpi_totals",
    """ SELECT (SELECT count(*) FROM call WHERE pipeline = 'gt') AS gt_total_snps, (SELECT count(*) FROM co WHERE pipeline = 'gt') AS core_gt_total, (SELECT count(*) FROM co WHERE pipeline = 'gt' AND cons) AS consensus_gt_total,
    (SELECT count(*) FROM smp) AS samples, (SELECT count(*) FROM pipe) AS pipelines, (SELECT n FROM n) AS ref_length""",
    core.V1,
)
def v1_kpi_totals(v):
    return reader.kpi_totals(v.call(reader_v1.BIN), v.ref_base(), v.samples(), core.pipelines(v), "gt", v.ref_len, v.carriers(), v.parts)


@query(
    "v1_pair_usable",
    """ SELECT pipeline, avg(usable) AS avg_usable_space, avg(usable) / any_value(n.n) * 100 AS avg_usable_space_pct, avg(disc) AS avg_usable_snps, min(disc) AS min_usable_snps, max(disc) AS max_usable_snps, median(disc) AS median_usable_snps, count(*) AS num_pairs FROM pd, n GROUP BY pipeline""",
    PAIR,
)
def v1_pair_usable(v):
    return reader.pair_usable(pairs(v), core.pipelines(v), v.ref_len)


@query(
    "v1_pair_usable_samples",
    """ SELECT pipeline, sample, avg(usable) AS avg_usable_space, avg(usable) / any_value(n.n) * 100 AS avg_usable_space_pct, avg(disc) AS avg_disc_snps FROM (SELECT pipeline, a AS sample, usable, disc FROM pd UNION ALL SELECT pipeline, b, usable, disc FROM pd), n GROUP BY pipeline, sample""",
    PAIR,
)
def v1_pair_usable_samples(v):
    return reader.pair_usable_samples(pairs(v), v.ref_len)


@query(
    "v1_truth_vs_calls",
    """, st AS (SELECT unnest(['gap_union', 'gap_intersect']) AS strategy), g AS (SELECT strategy, pos, base, sample, gapped, alt FROM dense CROSS JOIN st WHERE pipeline = 'gt'),
    kk AS (SELECT pos, k FROM gk WHERE pipeline = 'gt'), pl AS (SELECT unnest(['p1', 'p2']) AS pipeline),
    gd AS (SELECT strategy, pos FROM g WHERE strategy = 'gap_union' OR NOT gapped GROUP BY strategy, pos HAVING count(*) >= 2 AND count(DISTINCT coalesce(alt, '.')) > 1 AND (strategy <> 'gap_union' OR count(*) FILTER (gapped) = 0)),
    ac AS (SELECT g.strategy, g.pos, g.base, g.sample, g.alt FROM g JOIN gd USING (strategy, pos) WHERE g.strategy = 'gap_union' OR NOT g.gapped),
    x AS (SELECT pl.pipeline, a.strategy, a.pos, count(s.alt) > 0 AS same, count(q.pos) = 0 AND count(*) FILTER (coalesce(a.alt, a.base) <> coalesce(s.alt, a.base)) = 0 AS good
      FROM ac a CROSS JOIN pl LEFT JOIN snp s ON s.pipeline = pl.pipeline AND s.sample = a.sample AND s.pos = a.pos LEFT JOIN gp q ON q.pipeline = pl.pipeline AND q.sample = a.sample AND q.pos = a.pos GROUP BY ALL),
    t AS (SELECT s.pipeline, count(*) AS total, count(*) FILTER (coalesce(kk.k, 0) >= 1) AS u, count(*) FILTER (kk.k = 6) AS i FROM site s LEFT JOIN kk USING (pos) GROUP BY s.pipeline),
    pd AS (SELECT pipeline, count(*) AS d FROM (SELECT pipeline, pos FROM dense GROUP BY pipeline, pos HAVING count(DISTINCT coalesce(alt, '.')) > 1) GROUP BY pipeline)
    SELECT t.pipeline, st.strategy, t.total AS pl_total_core_snps, coalesce(pd.d, 0) AS pl_disc, (SELECT count(*) FROM gd WHERE gd.strategy = st.strategy) AS gt_disc, (SELECT count(*) FROM x WHERE x.pipeline = t.pipeline AND x.strategy = st.strategy AND same) AS same_pos,
      (SELECT count(*) FROM x WHERE x.pipeline = t.pipeline AND x.strategy = st.strategy AND same AND good) AS concordant, CASE st.strategy WHEN 'gap_union' THEN t.u ELSE t.i END AS pl_snps_in_gt_gaps
    FROM t JOIN pl USING (pipeline) CROSS JOIN st LEFT JOIN pd USING (pipeline)""",
)
def v1_truth_vs_calls(v):
    return truth.calls_summary(core.stored_sites(v), core.merged(v), "gt", v.samples(), pl_gaps=False, cover=v.cover())


# Per sample

PER = """ps AS (SELECT m.sample, p.pipeline, count(s.pos) AS snps, count(s.pos) FILTER (g.pos IS NOT NULL) AS snps_in_gt_gaps, (SELECT count(*) FROM snp t WHERE t.pipeline = 'gt' AND t.sample = m.sample) AS gt_snps,
  count(s.pos) FILTER (t.pos IS NOT NULL) AS intersection, count(s.pos) FILTER (t.alt = s.alt) AS agreement_with_gt FROM smp m CROSS JOIN (SELECT * FROM pipe WHERE pipeline <> 'gt') p
  LEFT JOIN snp s ON s.pipeline = p.pipeline AND s.sample = m.sample LEFT JOIN gp g ON g.pipeline = 'gt' AND g.sample = m.sample AND g.pos = s.pos
  LEFT JOIN snp t ON t.pipeline = 'gt' AND t.sample = m.sample AND t.pos = s.pos GROUP BY ALL),
cs AS (SELECT m.sample, p.pipeline, (SELECT count(*) FROM runs r WHERE r.pipeline = p.pipeline AND r.sample = m.sample) AS gap_regions, (SELECT count(*) FROM gp g WHERE g.pipeline = p.pipeline AND g.sample = m.sample) AS gap_bases FROM smp m CROSS JOIN pipe p)"""


@query("per_sample_stats", """ SELECT *, CASE WHEN snps > 0 THEN intersection / CAST(snps AS DOUBLE) * 100 ELSE 0 END AS pct_of_pipeline, CASE WHEN gt_snps > 0 THEN intersection / CAST(gt_snps AS DOUBLE) * 100 ELSE 0 END AS pct_of_gt FROM ps""", core.ISLAND, PER)
def per_sample_stats(v):
    return stats(v)


@query("coverage_stats", """ SELECT sample, pipeline, gap_regions, gap_bases, n.n - gap_bases AS covered_bases, (n.n - gap_bases) / CAST(n.n AS DOUBLE) * 100 AS coverage_pct FROM cs, n""", core.ISLAND, PER)
def coverage_stats(v):
    return reader.coverage_stats(v.gap(), v.samples(), core.pipelines(v), v.ref_len)


@query("truth_pileup", """ SELECT ps.sample, ps.pipeline, gt_snps AS total_snps, n.n - cs.gap_bases AS covered_positions, intersection AS shared, gt_snps - intersection AS gt_only, snps - intersection AS pipeline_only FROM ps JOIN cs ON cs.sample = ps.sample AND cs.pipeline = 'gt', n""", core.ISLAND, PER)
def truth_pileup(v):
    return reader.truth_pileup(core.snps(v), v.gap(), v.samples(), core.pipelines(v), "gt", v.ref_len)


@query("consensus_stats", """, c AS (SELECT a.sample, a.pos, a.alt, t.alt AS t FROM snp a JOIN snp b ON a.pipeline = 'p1' AND b.pipeline = 'p2' AND a.sample = b.sample AND a.pos = b.pos AND a.alt = b.alt LEFT JOIN snp t ON t.pipeline = 'gt' AND t.sample = a.sample AND t.pos = a.pos)
    SELECT sample, count(*) AS consensus, count(t) AS in_gt, count(*) FILTER (t = alt) AS agree_with_gt FROM c GROUP BY ROLLUP (sample)""")
def consensus_stats(v):
    return reader.consensus_stats(core.snps(v), ["p1", "p2"], "gt")


@query("pipeline_concordance", """, c AS (SELECT x.pipeline AS a, y.pipeline AS b, x.pos, count(*) AS m, count(*) FILTER (x.alt = y.alt) AS same FROM snp x JOIN snp y ON x.sample = y.sample AND x.pos = y.pos AND x.pipeline < y.pipeline GROUP BY ALL)
    SELECT x.pipeline AS a, y.pipeline AS b, count(c.pos) AS concordance_any, count(*) FILTER (m = 6) AS concordance_all, count(*) FILTER (same > 0) AS consensus_any, count(*) FILTER (same = 6) AS consensus_all FROM pipe x JOIN pipe y ON x.pipeline < y.pipeline LEFT JOIN c ON c.a = x.pipeline AND c.b = y.pipeline GROUP BY ALL""")
def pipeline_concordance(v):
    return reader.concordance(core.snps(v), core.N)


@query("v1_filtered_any_sample", """, f AS (SELECT pos, count(DISTINCT pipeline) AS n_all, bool_or(pipeline = 'p1') AS p1 FROM call GROUP BY pos)
    SELECT pos, n_all FROM f WHERE (p1 AND n_all = 1) OR pos IN (SELECT pos FROM gp WHERE pipeline = 'p2')""")
def v1_filtered_any_sample(v):
    return reader_v1.filter_positions(v.call(), core.merged(v), ["gt", "p1", "p2"], core.N, ["exclusive:p1", "gaps:p2"], any_of=True, any_sample=True)


# Lookups


@query("point_lookup", """, q AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'gt' WHEN 1 THEN 'p1' ELSE 'p2' END AS pipeline, 'S' || CAST(o_custkey % 6 AS VARCHAR) AS sample, o_orderkey AS pos FROM orders)
    SELECT q.*, r.base AS ref_nuc, c.alt, CASE WHEN c.alt IS NULL THEN '' ELSE concat_ws(',', r.base, c.alt, CAST(c.qual AS VARCHAR), CAST(c.dp AS VARCHAR)) END AS snp, g.pos IS NOT NULL AS is_gap FROM q LEFT JOIN ref_base r USING (pos) LEFT JOIN call c USING (pipeline, sample, pos) LEFT JOIN gp g USING (pipeline, sample, pos)""")
def point_lookup(v):
    points = v.table("orders").selectExpr("CASE o_orderkey % 3 WHEN 0 THEN 'gt' WHEN 1 THEN 'p1' ELSE 'p2' END AS pipeline", "concat('S', o_custkey % 6) AS sample", "o_orderkey AS pos")
    return reader.lookup(points, v.call(), v.gap(), v.ref_base())


@query("pair_lookup", """ SELECT x.sample AS a, y.sample AS b, q.quality, 'sample ' || x.sample AS label FROM smp x JOIN smp y ON x.sample <> y.sample JOIN pq q ON q.a = least(x.sample, y.sample) AND q.b = greatest(x.sample, y.sample) WHERE x.sample <> 'S0' UNION ALL
    SELECT x.sample, y.sample, q.quality, x.sample FROM smp x JOIN smp y ON x.sample <> y.sample JOIN pq q ON q.a = least(x.sample, y.sample) AND q.b = greatest(x.sample, y.sample) WHERE x.sample = 'S0'""", core.QUAL)
def pair_lookup(v):
    """All ordered pairs in either order; every sample but S0 has a label."""
    s = v.samples()
    wanted = s.select(F.col("sample").alias("a")).crossJoin(s.select(F.col("sample").alias("b"))).where("a != b")
    labels = s.where("sample != 'S0'").select(F.col("sample").alias("id"), F.concat(F.lit("sample "), "sample").alias("label"))
    return reader.labelled(reader.pair_lookup(wanted, core.gt_pairs(v).select("a", "b", "quality")), labels, "a")


# Distances and summaries

FILL = """cl AS (SELECT s.sample, s.pos, s.alt, c.qual >= 60 AND c.dp >= 14 AS ok FROM snp s JOIN call c USING (pipeline, sample, pos) WHERE s.pipeline = 'p1'), st AS (SELECT DISTINCT pos FROM cl),
bm AS (SELECT sample, pos, alt AS base FROM call WHERE pipeline = 'gt' AND dp >= 14 AND qual / 2 >= 40),
al AS (SELECT st.pos, m.sample, CASE WHEN cl.ok THEN cl.alt WHEN NOT cl.ok THEN NULL ELSE r.base END AS vcf_ref, CASE WHEN cl.ok THEN cl.alt WHEN NOT cl.ok THEN NULL ELSE bm.base END AS vcf_bam, bm.base AS bam_only
  FROM st CROSS JOIN smp m JOIN ref_base r USING (pos) LEFT JOIN cl ON cl.pos = st.pos AND cl.sample = m.sample LEFT JOIN bm ON bm.pos = st.pos AND bm.sample = m.sample),
fl AS (SELECT a.sample AS a, b.sample AS b, count(*) FILTER (a.vcf_ref <> b.vcf_ref) AS d1, count(*) FILTER (a.vcf_ref IS NOT NULL AND b.vcf_ref IS NOT NULL) AS c1, count(*) FILTER (a.vcf_bam <> b.vcf_bam) AS d2, count(*) FILTER (a.vcf_bam IS NOT NULL AND b.vcf_bam IS NOT NULL) AS c2,
  count(*) FILTER (a.bam_only <> b.bam_only) AS d3, count(*) FILTER (a.bam_only IS NOT NULL AND b.bam_only IS NOT NULL) AS c3 FROM al a JOIN al b ON a.pos = b.pos AND a.sample < b.sample GROUP BY ALL)"""


@query("filled_distances", """ SELECT 'vcf_ref' AS mode, a, b, d1 AS distance, c1 AS comparable FROM fl UNION ALL SELECT 'vcf_bam', a, b, d2, c2 FROM fl UNION ALL SELECT 'bam_only', a, b, d3, c3 FROM fl""", FILL)
def filled_distances(v):
    """Distances with filters of depth, agreement and quality; the truth's calls stand in for read consensus."""
    calls = v.call().where("pipeline = 'p1'").drop("pipeline")
    bases = v.call().where("pipeline = 'gt'").select("sample", "pos", F.col("alt").alias("base"), F.col("dp").alias("depth"), (F.col("qual") / 2).alias("consensus"))
    out = None
    for mode in distances.MODES:
        d = distances.filled(calls, bases, v.ref_base(), v.samples(), mode, 14, 40.0, 60.0).select(F.lit(mode).alias("mode"), "a", "b", "distance", "comparable")
        out = d if out is None else out.unionByName(d)
    return out


@query("validated_distances", """, o AS (SELECT pos, sample, CASE WHEN pos % 5 = 0 THEN NULL ELSE alt END AS base FROM call WHERE pipeline = 'gt'), r AS (SELECT pos FROM o GROUP BY pos HAVING count(base) >= 2 AND count(DISTINCT base) > 1)
    SELECT x.sample AS a, y.sample AS b, count(p.pos) AS distance FROM smp x JOIN smp y ON x.sample < y.sample LEFT JOIN (SELECT i.sample AS s, j.sample AS t, i.pos FROM o i JOIN o j ON i.pos = j.pos AND i.base <> j.base JOIN r ON r.pos = i.pos) p ON p.s = x.sample AND p.t = y.sample GROUP BY ALL""")
def validated_distances(v):
    o = v.call().where("pipeline = 'gt'").select(F.lit("c").alias("chrom"), "pos", "sample", F.when(F.col("pos") % 5 != 0, F.col("alt")).alias("base"))
    return distances.validated(o, v.samples())


def both_gaps(v):
    g = v.gap()
    return g.where("pipeline = 'p1'").drop("pipeline"), g.where("pipeline = 'p2'").drop("pipeline")


@query("one_sided_regions", """, a AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p1'), b AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p2'),
    x AS (SELECT sample, 'gap_only' AS side, pos FROM a ANTI JOIN b USING (sample, pos) UNION ALL SELECT sample, 'filtered_only', pos FROM b ANTI JOIN a USING (sample, pos)),
    y AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY sample, side ORDER BY pos) + 1 + 10 THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY sample, side ORDER BY pos) AS g FROM y)
    SELECT sample, side, min(pos) AS start, max(pos) + 1 AS "end" FROM z GROUP BY sample, side, g""")
def one_sided_regions(v):
    return callsets.one_sided_regions(*both_gaps(v))


@query(
    "filtered_summary",
    """, a AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p1'), b AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p2'),
    x AS (SELECT coalesce(a.sample, b.sample) AS sample, count(a.pos) AS na, count(b.pos) AS nb, count(a.pos) FILTER (b.pos IS NOT NULL) AS c FROM a FULL JOIN b ON a.sample = b.sample AND a.pos = b.pos GROUP BY 1)
    SELECT count(*) AS total_samples, avg(c / CAST(na + nb - c AS DOUBLE) * 100) AS avg_concordance_pct, CAST(sum(c) AS BIGINT) AS total_concordant_bases, CAST(sum(na - c) AS BIGINT) AS total_gap_only_bases, CAST(sum(nb - c) AS BIGINT) AS total_filtered_only_bases FROM x""",
)
def filtered_summary(v):
    return callsets.filtered_summary(callsets.compare_filtered(*both_gaps(v)))


@query(
    "retention_summary",
    """, g AS (SELECT sample, count(DISTINCT pos) AS b FROM gp WHERE pipeline = 'p1' GROUP BY sample), s AS (SELECT 'S' || CAST(range AS VARCHAR) AS sample, n - 100 * range AS aligned FROM range(6), n),
    k AS (SELECT c.sample, count(*) AS t, count(g.pos) AS i FROM snp c LEFT JOIN (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'gt') g USING (sample, pos) WHERE c.pipeline = 'p1' GROUP BY c.sample)
    SELECT count(*) AS total_samples, avg(abs((n - b - aligned) / CAST(n AS DOUBLE) * 100)) AS avg_core_diff_pct, (SELECT avg((t - i) / CAST(t AS DOUBLE) * 100) FROM k) AS avg_snp_retention_pct, (SELECT CAST(sum(t) AS BIGINT) FROM k) AS total_snps, (SELECT CAST(sum(i) AS BIGINT) FROM k) AS total_snps_in_gaps FROM g JOIN s USING (sample), n""",
)
def retention_summary(v):
    return callsets.retention_summary(core.core_difference(v), core.snp_retention(v))


# Text: MNPs, FORMAT columns, viewer readers, coverage of reads, the quality report


@query(
    "mnp_decomposition",
    lines._VCF + """, m AS (SELECT *, length(r) = length(a) AND length(r) > 1 AS mnp FROM t), c AS (SELECT mnp, CASE WHEN mnp THEN (SELECT count(*) FROM range(1, length(r) + 1) i WHERE substr(r, i.range, 1) <> substr(a, i.range, 1)) ELSE 0 END AS parts FROM m)
    SELECT count(*) FILTER (mnp) AS mnps_found, CAST(sum(parts) AS BIGINT) AS snps_from_mnps, 'Detected ' || count(*) FILTER (mnp) || ' MNP(s) (multi-nucleotide polymorphisms) which were automatically decomposed into ' || CAST(sum(parts) AS BIGINT) || ' individual SNPs' AS text FROM c""",
    plain=True,
)
def mnp_decomposition(v):
    rows = text.vcf_rows(v.spark, lines.vcf_lines(v)).withColumn("pos", F.col("pos_text").try_cast("long"))
    s = reader.mnp_stats(rows, [])
    return s.join(reader.mnp_warning(s))


@query(
    "format_fields",
    """SELECT l_orderkey AS k, l_linenumber AS n, '0/1' AS gt, CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 40 ELSE l_suppkey % 9 + l_partkey % 9 END AS depth,
    CASE WHEN l_linenumber % 3 = 2 THEN (l_suppkey % 100) / 100.0::DOUBLE WHEN l_suppkey % 9 + l_partkey % 9 > 0 THEN (l_partkey % 9) / CAST(l_suppkey % 9 + l_partkey % 9 AS DOUBLE) END AS af,
    CASE l_linenumber % 3 WHEN 1 THEN l_suppkey % 7 ELSE l_suppkey % 9 END AS ro, l_partkey % 9 AS ao, CASE WHEN l_linenumber % 3 = 1 THEN (l_partkey % 60)::DOUBLE END AS qa, CASE WHEN l_linenumber % 3 = 2 THEN 30.0::DOUBLE END AS gq, CASE WHEN l_linenumber % 3 = 2 THEN 0.05::DOUBLE END AS pval FROM lineitem""",
    plain=True,
)
def format_fields(v):
    """DP before AD, AD then RO and QA, AD then FREQ, RD, GQ and PVAL: what replaces what."""
    ad = "concat(l_suppkey % 9, ',', l_partkey % 9)"
    rows = v.table("lineitem").selectExpr(
        "l_orderkey AS k", "l_linenumber AS n", "CASE l_linenumber % 3 WHEN 0 THEN 'GT:DP:AD' WHEN 1 THEN 'GT:AD:RO:QA:DPX' ELSE 'GT:AD:FREQ:RD:GQ:PVAL:ABQ' END AS fmt",
        f"CASE l_linenumber % 3 WHEN 0 THEN concat_ws(':', '0/1', l_partkey % 40, {ad}) WHEN 1 THEN concat_ws(':', '0/1', {ad}, l_suppkey % 7, l_partkey % 60) ELSE concat_ws(':', '0/1', {ad}, concat(l_suppkey % 100, '%'), 99, 30, '0.05') END AS call",
    )
    return rows.withColumn("f", va.format_fields("fmt", "call")).select("k", "n", "f.gt", "f.depth", "f.af", "f.ro", "f.ao", "f.qa", "f.gq", "f.pval")


@query(
    "viewer_readers",
    lines._VCF + """, d AS (SELECT *, unnest(range(1, least(length(r), length(a)) + 1)) AS i FROM t), x AS (SELECT p + i - 1 AS pos, substr(r, i, 1) AS ref, substr(a, i, 1) AS alt, coalesce(q, 0) AS q, ln, sk, length(r) = length(a) AS same FROM d WHERE substr(r, i, 1) <> substr(a, i, 1))
    SELECT 'snippy' AS style, pos, ref, alt, CAST(q AS DOUBLE) AS qual, CAST(CASE WHEN ln % 3 = 0 THEN sk % 50 ELSE 0 END AS BIGINT) AS depth FROM x UNION ALL
    SELECT 'cfsan', pos, ref, alt, CAST(CASE WHEN ln % 3 = 1 THEN sk % 50 ELSE 0 END AS DOUBLE), CAST(CASE WHEN ln % 3 = 1 THEN sk % 50 ELSE 0 END AS BIGINT) FROM x WHERE same""",
    plain=True,
)
def viewer_readers(v):
    one = lambda s: text.viewer_snps(v.spark, lines.vcf_lines(v), s).select(F.lit(s).alias("style"), "pos", "ref", "alt", "qual", "depth")
    return one("snippy").unionByName(one("cfsan"))


_COVER = f"""WITH r AS ({lines._READS}), n AS (SELECT count(*) AS n FROM orders), s AS (SELECT 'S' || CAST(range AS VARCHAR) AS sample, range AS i FROM range(6)), p AS (
  SELECT pos % 5 AS i, unnest(range(pos - 1, least(pos - 1 + m1 + m2 + CASE WHEN kind = 0 THEN 0 ELSE gap END, n))) AS p FROM r, n WHERE NOT unmapped AND pos >= 1
), d AS (SELECT i, p, count(*) AS k FROM p GROUP BY ALL), m AS (SELECT s.sample, count(d.p) AS total_reads, coalesce(sum(k), 0) / CAST(any_value(n.n) AS DOUBLE) AS mean_depth, count(*) FILTER (k >= 2) AS deep, any_value(n.n) AS n FROM s CROSS JOIN n LEFT JOIN d USING (i) GROUP BY s.sample)"""


def covered(v):
    sample = F.concat(F.lit("S"), (F.col("pos") % 5).cast("string"))
    return alignments.read_metrics(lines.reads(v).withColumn("sample", sample), v.samples(), v.ref_len, 2)


@query("fastq_coverage_metrics", _COVER + " SELECT sample, total_reads, total_reads AS mapped_reads, mean_depth, deep / CAST(n AS DOUBLE) * 100 AS coverage_percent, n - deep AS total_gap_bases FROM m", plain=True)
def fastq_coverage_metrics(v):
    """Coverage of reads by sample at a minimum depth of 2; one sample has no read."""
    return covered(v)


@query("alignment_averages", _COVER + " SELECT 1.0::DOUBLE AS avg_identity, avg(deep / CAST(n AS DOUBLE)) AS avg_sample_coverage, avg(deep / CAST(n AS DOUBLE)) AS avg_reference_coverage FROM m", plain=True)
def alignment_averages(v):
    return alignments.averages(alignments.reads_as_alignments(covered(v), v.ref_len))


QREP = """al AS (SELECT mt.sample, ref_identity AS identity, ref_coverage AS coverage FROM mt), ln AS (
  SELECT 1 AS part, '0' AS n, concat_ws(chr(9), 'sample', 'score', 'flagged', 'recommendation', 'flags', 'ref_coverage', 'gap_quality', 'unique_gaps', 'n50', 'num_contigs') AS value
  UNION ALL SELECT 1, '1' || chr(9) || sample, concat_ws(chr(9), sample, printf('%.4f', score), CASE WHEN flags <> '' THEN 'true' ELSE 'false' END, CASE WHEN score >= 0.5 THEN 'EXCLUDE' WHEN score >= 0.2 OR flags <> '' THEN 'REVIEW' ELSE 'OK' END,
    CASE WHEN flags = '' THEN '-' ELSE flags END, printf('%.4f', ref_coverage), printf('%.4f', avg_quality), CAST(total_unique AS VARCHAR), CAST(sc.n50 AS VARCHAR), CAST(nf.n_contigs AS VARCHAR)) FROM sc JOIN nf USING (sample)
  UNION ALL SELECT 2, '0a', '' UNION ALL SELECT 2, '0b', '# Gap Quality Matrix (intersection/union)' UNION ALL SELECT 2, '0c', 'sample' || chr(9) || string_agg(sample, chr(9) ORDER BY sample) FROM smp
  UNION ALL SELECT 2, '1' || chr(9) || x.sample, x.sample || chr(9) || string_agg(printf('%.4f', CASE WHEN x.sample = y.sample THEN 1.0::DOUBLE ELSE q.quality END), chr(9) ORDER BY y.sample) FROM smp x CROSS JOIN smp y LEFT JOIN pq q ON q.a = least(x.sample, y.sample) AND q.b = greatest(x.sample, y.sample) GROUP BY x.sample
  UNION ALL SELECT 3, '0a', '' UNION ALL SELECT 3, '0b', '# Reference Summary' UNION ALL SELECT 3, '10', 'reference_name' || chr(9) || 'c1' UNION ALL SELECT 3, '11', 'reference_length' || chr(9) || n FROM n
  UNION ALL SELECT 3, '12', 'avg_identity' || chr(9) || printf('%.4f', avg(identity)) FROM al UNION ALL SELECT 3, '13', 'avg_sample_coverage' || chr(9) || printf('%.4f', avg(coverage)) FROM al UNION ALL SELECT 3, '14', 'avg_reference_coverage' || chr(9) || printf('%.4f', avg(coverage)) FROM al)"""


def quality(v) -> Quality:
    gaps = v.gap().where("pipeline = 'gt'").select("sample", "start", "end")
    own = iv.merge(gaps, ["sample"]).groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("g"))
    m = v.samples().join(v.contig().groupBy("sample").agg(F.sum("length").alias("t")), "sample").join(own, "sample", "left")
    cover = (F.lit(v.ref_len) - F.coalesce("g", F.lit(0))) / F.lit(float(v.ref_len))
    m = m.select("sample", (0.9 + (F.col("t") % 100) / F.lit(1000.0)).alias("identity"), cover.alias("sample_coverage"), cover.alias("reference_coverage"))
    return Quality(gaps, v.contig(), m, "c1", v.ref_len, samples=v.samples())


@query("quality_report_lines", " SELECT part, n, value FROM ln", core.QUAL, QREP)
def quality_report_lines(v):
    return quality(v).lines()


@query("samples_by_unique_gaps", """, un AS (SELECT sample, count(*) AS u FROM gp JOIN gk USING (pipeline, pos) WHERE pipeline = 'gt' AND k = 1 GROUP BY sample) SELECT m.sample, coalesce(u, 0) AS unique_bases, row_number() OVER (ORDER BY coalesce(u, 0), m.sample) AS place FROM smp m LEFT JOIN un USING (sample)""")
def samples_by_unique_gaps(v):
    return viewer.by_unique_gaps(quality(v).impact())
