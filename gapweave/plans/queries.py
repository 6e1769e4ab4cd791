"""The registered queries of the engine and, beside each, its oracle in SQL.

The oracles explode positions and densify, which the engine never does, so they are another way to the
same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import callsets, distances, features, qc, reader_v1, sites, truth, viewer
from gapweave.plans.views import PIPES, SQL, Views, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PS = ["pipeline", "sample"]
N = 6


def query(name: str, sql: str | None, *ctes: str, whole: bool = False):
    """Registers a query and its SQL, the end of a statement that begins with the views unless it is ``whole``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if whole else oracle(sql, *ctes)
        return f

    return add


def merged(v: Views) -> DataFrame:
    """The merged gaps, written once for all that a query reads of them."""
    return v.merged_gaps()


def pipelines(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("gt",), ("p1",), ("p2",)], "pipeline string")


def snps(v: Views) -> DataFrame:
    return sites.snps(v.call(), v.ref_base())


def site_table(v: Views) -> DataFrame:
    return sites.site_table(snps(v), merged(v), N, v.cover())


def stored_sites(v: Views) -> DataFrame:
    """The sites for queries that read them several times."""
    return v.once("sites", lambda: site_table(v))


def core(v: Views) -> DataFrame:
    allele = F.expr("CASE WHEN pos % 11 = 0 THEN 'N' WHEN pos % 13 = 0 THEN '-' ELSE alt END")
    return v.call().where("pipeline != 'gt'").select("pipeline", "pos", "sample", allele.alias("allele"))


def core_table(v: Views) -> DataFrame:
    return v.once("core", lambda: truth.core_table(core(v)))


# Intervals

ISLAND = """isl AS (
  SELECT pipeline, sample, pos, pos - row_number() OVER (PARTITION BY pipeline, sample ORDER BY pos) AS g FROM gp
), runs AS (SELECT pipeline, sample, min(pos) AS s, max(pos) + 1 AS e FROM isl GROUP BY pipeline, sample, g)"""


@query("interval_merge", 'SELECT pipeline, sample, s AS start, e AS "end" FROM runs', ISLAND)
def interval_merge(v):
    return iv.merge(v.gap(), PS)


@query(
    "interval_complement",
    """, u AS (SELECT p.pipeline, m.sample, r.pos FROM pipe p CROSS JOIN smp m CROSS JOIN ref_base r
      WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.pipeline = p.pipeline AND gp.sample = m.sample AND gp.pos = r.pos)),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY pipeline, sample ORDER BY pos) AS g FROM u)
    SELECT pipeline, sample, min(pos) AS start, max(pos) + 1 AS "end" FROM i GROUP BY pipeline, sample, g""",
)
def interval_complement(v):
    keys = pipelines(v).crossJoin(v.samples()).withColumn("length", F.lit(v.ref_len))
    return iv.complement(v.gap(), PS, keys)


@query("coverage_histogram", "SELECT pipeline, CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS positions FROM gk GROUP BY pipeline, k")
def coverage_histogram(v):
    return iv.sweep(iv.merge(v.gap(), PS), ["pipeline"]).groupBy("pipeline", "k").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


@query("gap_union_intersect", f"SELECT pipeline, CAST(count(*) AS BIGINT) AS gap_union, CAST(count(*) FILTER (k = {N}) AS BIGINT) AS gap_intersect FROM gk GROUP BY pipeline")
def gap_union_intersect(v):
    return sites.gap_sizes(iv.merge(v.gap(), PS), N)


@query(
    "unique_gaps",
    "SELECT pipeline, sample, CAST(count(*) FILTER (k = 1) AS BIGINT) AS unique_bases, CAST(count(*) FILTER (k > 1) AS BIGINT) AS shared_bases FROM gp JOIN gk USING (pipeline, pos) GROUP BY pipeline, sample",
)
def unique_gaps(v):
    return qc.unique_shared(merged(v), ["pipeline"])


@query("regions_bridged", """, c AS (SELECT DISTINCT pipeline, sample, pos FROM call), l AS (
      SELECT *, CASE WHEN pos - lag(pos) OVER w <= 6 THEN 0 ELSE 1 END AS f FROM c WINDOW w AS (PARTITION BY pipeline, sample ORDER BY pos)),
    g AS (SELECT *, sum(f) OVER (PARTITION BY pipeline, sample ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM l)
    SELECT pipeline, sample, min(pos) AS start, max(pos) + 1 AS "end" FROM g GROUP BY pipeline, sample, i""")
def regions_bridged(v):
    return iv.regions(v.call(), PS, max_gap=5)


@query("depth_gap_runs", """, d AS (SELECT o_orderkey AS pos, CAST(o_custkey % 12 AS BIGINT) AS depth FROM orders), i AS (
      SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM d WHERE depth < 5)
    SELECT 'x' AS sample, min(pos) AS start, max(pos) + 1 AS "end" FROM i GROUP BY g""")
def depth_gap_runs(v):
    depth = v.table("orders").selectExpr("'x' AS sample", "o_orderkey AS pos", "o_custkey % 12 AS depth")
    return iv.depth_gaps(depth, ["sample"], 5)


@query("gap_density", "SELECT pipeline, sample, CAST(pos // 500 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS bases FROM gp GROUP BY ALL")
def gap_density(v):
    return iv.density(merged(v), PS, 500).drop("touches")


@query("calls_in_gaps", "SELECT c.pipeline, c.sample, CAST(count(*) AS BIGINT) AS calls, CAST(count(g.pos) AS BIGINT) AS in_gaps FROM call c LEFT JOIN gp g USING (pipeline, sample, pos) GROUP BY c.pipeline, c.sample")
def calls_in_gaps(v):
    hit = iv.locate(v.call(), iv.merge(v.gap(), PS), PS, [])
    return hit.groupBy(*PS).agg(F.count(F.lit(1)).alias("calls"), F.count_if("inside").alias("in_gaps"))


@query("calls_in_gaps_inclusive", "SELECT c.pipeline, c.sample, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM gap g WHERE g.pipeline = c.pipeline AND g.sample = c.sample AND c.pos >= g.s AND c.pos <= g.e)) AS BIGINT) AS in_gaps FROM call c GROUP BY c.pipeline, c.sample")
def calls_in_gaps_inclusive(v):
    return iv.locate(v.call(), iv.closed(v.gap(), PS), PS, []).groupBy(*PS).agg(F.count_if("inside").alias("in_gaps"))


@query(
    "pairwise_gap_quality",
    """, own AS (SELECT p.pipeline, m.sample, count(g.pos) AS n FROM pipe p CROSS JOIN smp m LEFT JOIN gp g ON g.pipeline = p.pipeline AND g.sample = m.sample GROUP BY ALL),
    sh AS (SELECT a.pipeline, a.sample AS a, b.sample AS b, count(*) AS i FROM gp a JOIN gp b ON a.pipeline = b.pipeline AND a.pos = b.pos AND a.sample < b.sample GROUP BY ALL)
    SELECT x.pipeline, x.sample AS a, y.sample AS b, CAST(x.n + y.n - coalesce(i, 0) AS BIGINT) AS gap_union, CAST(coalesce(i, 0) AS BIGINT) AS gap_intersection,
      CASE WHEN x.n + y.n - coalesce(i, 0) = 0 THEN 1.0 ELSE coalesce(i, 0) / CAST(x.n + y.n - coalesce(i, 0) AS DOUBLE) END AS quality,
      CAST(x.n - coalesce(i, 0) AS BIGINT) AS unique_a, CAST(y.n - coalesce(i, 0) AS BIGINT) AS unique_b, CAST(n.n - (x.n + y.n - coalesce(i, 0)) AS BIGINT) AS core
    FROM own x JOIN own y ON x.pipeline = y.pipeline AND x.sample < y.sample CROSS JOIN n LEFT JOIN sh ON sh.pipeline = x.pipeline AND sh.a = x.sample AND sh.b = y.sample""",
)
def pairwise_gap_quality(v):
    return qc.pairwise_gaps(merged(v), pipelines(v).crossJoin(v.samples()), ["pipeline"], v.ref_len)


# Sites

CLS = f"""st AS (
  SELECT pipeline, pos, min(base) AS base, count(*) FILTER (gapped) AS k, count(*) FILTER (NOT gapped) AS present,
         count(DISTINCT allele) FILTER (NOT gapped) AS na, count(DISTINCT allele) FILTER (NOT gapped AND allele <> base) AS nonref
  FROM dense GROUP BY pipeline, pos
), cl AS (SELECT *, present >= 2 AND na >= 2 AS disc, present >= 2 AND na = 1 AND nonref = 1 AS cons FROM st),
strat AS (SELECT unnest(['gap_union', 'gap_intersect']) AS strategy),
live AS (SELECT c.*, strategy FROM cl c CROSS JOIN strat WHERE CASE strategy WHEN 'gap_union' THEN k = 0 ELSE k < {N} END)"""


@query(
    "site_classification",
    f""" SELECT p.pipeline, s.strategy,
      CAST(n.n - (SELECT count(*) FROM gk WHERE gk.pipeline = p.pipeline AND (s.strategy = 'gap_union' OR k = {N})) AS BIGINT) AS usable_space,
      CAST(count(l.pos) AS BIGINT) AS total_snps, CAST(count(l.pos) FILTER (cons) AS BIGINT) AS consensus_snps,
      CAST(count(l.pos) FILTER (disc) AS BIGINT) AS disc_snps, CAST(count(l.pos) FILTER (k > 0) AS BIGINT) AS missing_vcf
    FROM pipe p CROSS JOIN strat s CROSS JOIN n LEFT JOIN live l ON l.pipeline = p.pipeline AND l.strategy = s.strategy GROUP BY p.pipeline, s.strategy, n.n""",
    CLS,
)
def site_classification(v):
    g = merged(v)
    return sites.global_stats(site_table(v), g, pipelines(v), N, v.ref_len, v.cover())


@query("pipeline_kpis", " SELECT p.pipeline, (SELECT count(*) FROM site s WHERE s.pipeline = p.pipeline) AS n_sites, (SELECT count(*) FROM gk WHERE gk.pipeline = p.pipeline) AS gap_positions, (SELECT count(*) FROM cl WHERE cl.pipeline = p.pipeline AND k = 0 AND disc) AS core_snps FROM pipe p", CLS)
def pipeline_kpis(v):
    return sites.kpis(site_table(v), merged(v), pipelines(v), N, v.cover())


@query(
    "disc_breakdown",
    f""", cnt AS (SELECT pipeline, pos, allele, count(*) AS c FROM dense GROUP BY ALL), mx AS (SELECT pipeline, pos, max(c) AS c FROM cnt GROUP BY ALL),
    gt AS (SELECT r.pos, count(DISTINCT coalesce(s.alt, r.base)) AS d FROM ref_base r CROSS JOIN smp m LEFT JOIN snp s ON s.pipeline = 'gt' AND s.sample = m.sample AND s.pos = r.pos GROUP BY r.pos),
    f AS (SELECT c.pipeline, CASE WHEN gt.d = 1 THEN 'g' WHEN mx.c = c.present - 1 THEN 'm' ELSE 'c' END AS f FROM cl c JOIN mx USING (pipeline, pos) JOIN gt USING (pos) WHERE c.pipeline <> 'gt' AND k = 0 AND disc)
    SELECT pipeline, CAST(0 AS BIGINT) AS gap_affected, CAST(count(*) FILTER (f = 'g') AS BIGINT) AS gt_consensus, CAST(count(*) FILTER (f = 'm') AS BIGINT) AS majority_rule, CAST(count(*) FILTER (f = 'c') AS BIGINT) AS confirmed FROM f GROUP BY pipeline""",
    CLS,
)
def disc_breakdown(v):
    calls = v.once("snps", lambda: snps(v))
    return sites.breakdown(calls, sites.site_table(calls, merged(v), N, v.cover()), "gt", N)


PAIRS = """pr AS (
  SELECT p.pipeline, x.sample AS a, y.sample AS b,
    (SELECT n FROM n) - (SELECT count(DISTINCT pos) FROM gp WHERE gp.pipeline = p.pipeline AND gp.sample IN (x.sample, y.sample)) AS usable_space
  FROM pipe p CROSS JOIN smp x JOIN smp y ON x.sample < y.sample
), df AS (
  SELECT a.pipeline, a.sample AS a, b.sample AS b, count(*) AS d FROM dense a JOIN dense b ON a.pipeline = b.pipeline AND a.pos = b.pos AND a.sample < b.sample
  WHERE NOT a.gapped AND NOT b.gapped AND a.allele <> b.allele GROUP BY ALL
), ps AS (SELECT pr.pipeline, pr.a, pr.b, CAST(usable_space AS BIGINT) AS usable_space, CAST(coalesce(d, 0) AS BIGINT) AS disc_snps FROM pr LEFT JOIN df USING (pipeline, a, b))"""


@query("pair_stats", " SELECT * FROM ps", PAIRS)
def pair_stats(v):
    return sites.pair_stats(stored_sites(v), merged(v), pipelines(v), v.samples(), v.ref_len)


@query("pair_summary", " SELECT pipeline, count(*) AS num_pairs, min(disc_snps) AS disc_min, max(disc_snps) AS disc_max, avg(disc_snps) AS disc_avg, median(disc_snps) AS disc_median, avg(usable_space) AS usable_avg FROM ps GROUP BY pipeline", PAIRS)
def pair_summary(v):
    return sites.pair_summary(pair_stats(v))


@query("pair_per_sample", " SELECT pipeline, sample, avg(usable_space) AS avg_usable_space, avg(disc_snps) AS avg_disc_snps, count(*) AS num_pairs FROM (SELECT pipeline, unnest([a, b]) AS sample, usable_space, disc_snps FROM ps) GROUP BY ALL", PAIRS)
def pair_per_sample(v):
    return sites.per_sample_pairs(pair_stats(v))


# Ground truth

GTD = f"""core AS (
  SELECT pipeline, pos, sample, CASE WHEN pos % 11 = 0 THEN 'N' WHEN pos % 13 = 0 THEN '-' ELSE alt END AS allele FROM call WHERE pipeline <> 'gt'
), cd AS (SELECT pipeline, pos, count(DISTINCT allele) FILTER (allele NOT IN ('N', '-')) > 1 AS d FROM core GROUP BY ALL),
strat AS (SELECT unnest(['gap_union', 'gap_intersect']) AS strategy),
gtk AS (SELECT pos, count(*) AS k FROM gp WHERE pipeline = 'gt' GROUP BY pos),
gtv AS (SELECT pos, sample, base, gapped, alt FROM dense WHERE pipeline = 'gt'),
gtd AS (
  SELECT g.pos, strategy FROM gtv g CROSS JOIN strat LEFT JOIN gtk USING (pos) GROUP BY g.pos, strategy
  HAVING CASE strategy WHEN 'gap_union' THEN max(coalesce(k, 0)) = 0 AND count(DISTINCT coalesce(alt, '.')) > 1
         ELSE max(coalesce(k, 0)) < {N} AND count(*) FILTER (NOT gapped) >= 2 AND count(DISTINCT coalesce(alt, '.')) FILTER (NOT gapped) > 1 END
), pls AS (SELECT DISTINCT pipeline FROM core),
act AS (SELECT d.strategy, g.* FROM gtd d JOIN gtv g USING (pos) WHERE d.strategy = 'gap_union' OR NOT g.gapped),
agr AS (
  SELECT p.pipeline, a.strategy, a.pos, bool_and(coalesce(a.alt, a.base) = coalesce(c.allele, a.base)) AS ok
  FROM act a CROSS JOIN pls p LEFT JOIN core c ON c.pipeline = p.pipeline AND c.pos = a.pos AND c.sample = a.sample GROUP BY ALL
), det AS (
  SELECT g.pipeline, g.strategy, g.pos, CASE WHEN cd.d IS NULL AND EXISTS (SELECT 1 FROM gp WHERE gp.pipeline = g.pipeline AND gp.pos = g.pos) THEN 'in_pl_gap'
    WHEN cd.d IS NULL THEN 'lost' WHEN NOT cd.d THEN 'not_disc_in_pl' WHEN g.ok THEN 'concordant' ELSE 'discordant' END AS status
  FROM agr g LEFT JOIN cd USING (pipeline, pos)
  UNION ALL
  SELECT cd.pipeline, strategy, cd.pos, CASE WHEN (strategy = 'gap_union' AND k >= 1) OR k = {N} THEN 'in_gt_gap' ELSE 'pl_only' END
  FROM cd CROSS JOIN strat LEFT JOIN gtk USING (pos)
  WHERE cd.d AND (((strategy = 'gap_union' AND k >= 1) OR k = {N}) IS TRUE OR NOT EXISTS (SELECT 1 FROM gtd WHERE gtd.pos = cd.pos AND gtd.strategy = strat.strategy))
)"""


def gt_inputs(v):
    gaps = merged(v)
    s = stored_sites(v).where("pipeline = 'gt'")
    return s, gaps.where("pipeline = 'gt'"), gaps.where("pipeline != 'gt'")


@query("truth_position_details", " SELECT * FROM det", GTD)
def truth_position_details(v):
    s, g, p = gt_inputs(v)
    return truth.core_details(s, g, core(v), p, v.samples(), v.cover(), "gt", core_table(v))


@query(
    "truth_vs_core",
    """ SELECT d.pipeline, d.strategy, (SELECT count(*) FROM cd WHERE cd.pipeline = d.pipeline) AS pl_total_core_snps, (SELECT count(*) FROM cd WHERE cd.pipeline = d.pipeline AND d) AS pl_disc,
      count(*) FILTER (status NOT IN ('in_gt_gap', 'pl_only')) AS gt_disc, count(*) FILTER (status IN ('concordant', 'discordant')) AS same_pos,
      count(*) FILTER (status = 'concordant') AS concordant, count(*) FILTER (status = 'in_gt_gap') AS pl_snps_in_gt_gaps FROM det d GROUP BY d.pipeline, d.strategy""",
    GTD,
)
def truth_vs_core(v):
    return truth.core_summary(truth_position_details(v), core(v), core_table(v))


GTP = """pd AS (
  SELECT a.pos, a.base, a.sample AS a, b.sample AS b, a.alt AS aa, b.alt AS ba FROM gtv a JOIN gtv b ON a.pos = b.pos AND a.sample < b.sample
  WHERE NOT a.gapped AND NOT b.gapped AND a.alt IS DISTINCT FROM b.alt
)"""


@query(
    "truth_vs_core_pairs",
    """ SELECT p.pipeline, CAST(15 AS BIGINT) AS num_pairs, (SELECT count(*) FROM pd) / 15.0::DOUBLE AS gt_disc_avg, count(cd.pos) / 15.0::DOUBLE AS same_pos_avg,
      count(cd.pos) FILTER (coalesce(aa, base) = coalesce(x.allele, base) AND coalesce(ba, base) = coalesce(y.allele, base)) / 15.0::DOUBLE AS concordant_avg
    FROM pls p CROSS JOIN pd JOIN cd ON cd.pipeline = p.pipeline AND cd.pos = pd.pos AND cd.d LEFT JOIN core x ON x.pipeline = p.pipeline AND x.pos = pd.pos AND x.sample = pd.a
    LEFT JOIN core y ON y.pipeline = p.pipeline AND y.pos = pd.pos AND y.sample = pd.b GROUP BY p.pipeline""",
    GTD,
    GTP,
)
def truth_vs_core_pairs(v):
    s, g, _ = gt_inputs(v)
    return truth.core_pairs(s, g, core(v), v.samples())


VCFGT = """pv AS (SELECT pipeline, pos, sample, base, gapped, alt FROM dense WHERE pipeline <> 'gt'),
pdisc AS (SELECT pipeline, pos FROM pv GROUP BY ALL HAVING count(*) FILTER (NOT gapped) >= 2 AND count(DISTINCT coalesce(alt, '.')) FILTER (NOT gapped) > 1),
va AS (
  SELECT s.pipeline, a.strategy, a.pos, bool_or(v.alt IS NOT NULL) AS same, bool_or(coalesce(v.gapped, FALSE)) AS anygap, bool_and(coalesce(a.alt, a.base) = coalesce(v.alt, a.base)) AS eq
  FROM act a CROSS JOIN (SELECT DISTINCT pipeline FROM pv) s LEFT JOIN pv v ON v.pipeline = s.pipeline AND v.pos = a.pos AND v.sample = a.sample GROUP BY ALL
)"""


@query(
    "truth_vs_calls",
    f""" SELECT va.pipeline, va.strategy, (SELECT count(*) FROM site s WHERE s.pipeline = va.pipeline) AS pl_total_core_snps, (SELECT count(*) FROM pdisc d WHERE d.pipeline = va.pipeline) AS pl_disc,
      count(*) AS gt_disc, count(*) FILTER (same) AS same_pos, count(*) FILTER (same AND NOT anygap AND eq) AS concordant,
      (SELECT count(*) FROM site s JOIN gtk USING (pos) WHERE s.pipeline = va.pipeline AND (va.strategy = 'gap_union' OR k = {N})) AS pl_snps_in_gt_gaps
    FROM va GROUP BY va.pipeline, va.strategy""",
    GTD,
    VCFGT,
)
def truth_vs_calls(v):
    return truth.calls_summary(stored_sites(v), merged(v), "gt", v.samples(), cover=v.cover())


@query(
    "truth_vs_calls_pairs",
    """ SELECT x.pipeline, CAST(15 AS BIGINT) AS num_pairs, (SELECT count(*) FROM pd) / 15.0::DOUBLE AS gt_disc_avg, count(*) FILTER (x.alt IS NOT NULL OR y.alt IS NOT NULL) / 15.0::DOUBLE AS same_pos_avg,
      count(*) FILTER ((x.alt IS NOT NULL OR y.alt IS NOT NULL) AND NOT x.gapped AND NOT y.gapped AND coalesce(aa, pd.base) = coalesce(x.alt, pd.base) AND coalesce(ba, pd.base) = coalesce(y.alt, pd.base)) / 15.0::DOUBLE AS concordant_avg
    FROM pd JOIN pv x ON x.pos = pd.pos AND x.sample = pd.a JOIN pv y ON y.pipeline = x.pipeline AND y.pos = pd.pos AND y.sample = pd.b GROUP BY x.pipeline""",
    GTD,
    VCFGT,
    GTP,
)
def truth_vs_calls_pairs(v):
    return truth.calls_pairs(stored_sites(v), merged(v), "gt", v.samples())


# Calls as their lines give them: some positions of a sample stand on several lines.  The last one that isn't alike the reference counts.

LINES = f"""line AS (
  SELECT {PIPES.format(k="l_linenumber")} AS pipeline, 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS sample, l_orderkey AS pos, substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS alt, l_linenumber AS n FROM lineitem
), lsnp AS (SELECT l.pipeline, l.sample, l.pos, l.alt, r.base FROM line l JOIN ref_base r USING (pos) WHERE l.alt <> r.base QUALIFY row_number() OVER (PARTITION BY l.pipeline, l.sample, l.pos ORDER BY n DESC, l.alt DESC) = 1)"""
#: The head of the oracles with these calls in the place of one for each position.
_LINE_SQL = SQL.replace("snp AS (SELECT c.pipeline, c.sample, c.pos, c.alt, r.base FROM call c JOIN ref_base r USING (pos) WHERE c.alt <> r.base)", LINES + ", snp AS (SELECT * FROM lsnp)")


def line_calls(v: Views) -> DataFrame:
    lines = v.table("lineitem").selectExpr(f"{PIPES.format(k='l_linenumber')} AS pipeline", "concat('S', CAST(l_suppkey % 6 AS STRING)) AS sample", "l_orderkey AS pos", "substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS alt", "CAST(l_linenumber AS BIGINT) AS n")
    return v.dealt(lines)


def line_sites(v: Views) -> DataFrame:
    return v.once("sites", lambda: sites.site_table(sites.snps(line_calls(v), v.ref_base()), merged(v), N, v.cover()))


@query("last_call_classification", ORACLES["site_classification"].replace(SQL, _LINE_SQL), whole=True)
def last_call_classification(v):
    return sites.global_stats(line_sites(v), merged(v), pipelines(v), N, v.ref_len, v.cover())


@query("last_call_pairs", ORACLES["pair_stats"].replace(SQL, _LINE_SQL), whole=True)
def last_call_pairs(v):
    return sites.pair_stats(line_sites(v), merged(v), pipelines(v), v.samples(), v.ref_len)


@query("last_call_truth", ORACLES["truth_vs_calls"].replace(SQL, _LINE_SQL), whole=True)
def last_call_truth(v):
    return truth.calls_summary(line_sites(v), merged(v), "gt", v.samples(), cover=v.cover())


# A core table with a position on two contigs and a line that comes twice.

CORE_LINES = f"""craw AS (
  SELECT CASE l_linenumber % 2 WHEN 0 THEN 'p1' ELSE 'p2' END AS pipeline, 'c' || CAST(l_linenumber // 4 AS VARCHAR) AS chrom, l_orderkey AS pos, 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS sample,
    CASE l_partkey % 9 WHEN 0 THEN 'N' WHEN 1 THEN '-' ELSE substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) END AS allele, CAST(l_linenumber // 4 AS BIGINT) AS n, l_linenumber AS i FROM lineitem
), cone AS (SELECT * FROM craw QUALIFY row_number() OVER (PARTITION BY pipeline, pos, n, sample ORDER BY i DESC, allele DESC) = 1),
cdis AS (SELECT pipeline, pos, n, count(DISTINCT allele) FILTER (allele NOT IN ('N', '-')) > 1 AS d FROM craw GROUP BY ALL),
clast AS (SELECT c.* FROM cone c JOIN (SELECT pipeline, pos, max(n) AS n FROM craw GROUP BY ALL) m ON m.pipeline = c.pipeline AND m.pos = c.pos AND m.n = c.n)"""


@query(
    "core_repeated_lines",
    """ SELECT pipeline, pos, (SELECT string_agg(sample || allele, ',' ORDER BY sample) FROM clast l WHERE l.pipeline = d.pipeline AND l.pos = d.pos) AS alleles, bool_or(d) AS core_disc, count(*) AS lines
    FROM cdis d GROUP BY pipeline, pos""",
    CORE_LINES,
)
def core_repeated_lines(v):
    """Of a position on several lines of a core table: the alleles of the last, whether any discriminates, and how many there are."""
    rows = v.table("lineitem").selectExpr(
        "CASE l_linenumber % 2 WHEN 0 THEN 'p1' ELSE 'p2' END AS pipeline", "concat('c', l_linenumber div 4) AS chrom", "l_orderkey AS pos", "concat('S', l_suppkey % 6) AS sample",
        "CASE l_partkey % 9 WHEN 0 THEN 'N' WHEN 1 THEN '-' ELSE substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) END AS allele", "CAST(l_linenumber div 4 AS BIGINT) AS n", "l_linenumber AS i",
    )
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], x["value"])), ",")
    return truth.core_table(rows).select("pipeline", "pos", text.alias("alleles"), "core_disc", "lines")


# Call sets

CALLSET = """ca AS (SELECT sample, 'c' || CAST(pos % 3 AS VARCHAR) AS chrom, pos, alt, qual, dp AS depth, CAST(pos % 10 AS DOUBLE) / 10 AS af FROM call WHERE pipeline = 'p1'),
cb AS (SELECT sample, 'c' || CAST(pos % 3 AS VARCHAR) AS chrom, pos, alt, qual, dp AS depth, CAST(pos % 10 AS DOUBLE) / 10 AS af FROM call WHERE pipeline = 'p2'),
gs AS (SELECT sample, s, e FROM gap WHERE pipeline = 'gt'),
cj AS (
  SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, a.alt AS a_alt, b.alt AS b_alt, a.qual AS a_qual, b.qual AS b_qual, a.depth AS a_depth, b.depth AS b_depth,
    a.af AS a_af, b.af AS b_af, CASE WHEN a.alt IS NULL THEN 'OnlyPipelineB' WHEN b.alt IS NULL THEN 'OnlyPipelineA' WHEN a.alt = b.alt THEN 'Concordant' ELSE 'DiscordantAllele' END AS status
  FROM ca a FULL JOIN cb b ON a.sample = b.sample AND a.chrom = b.chrom AND a.pos = b.pos
), cg AS (SELECT *, EXISTS (SELECT 1 FROM gs WHERE gs.sample = cj.sample AND cj.pos >= gs.s AND cj.pos <= gs.e) AS in_gap FROM cj),
cps AS (
  SELECT sample, count(a_alt) AS snps_a, count(b_alt) AS snps_b, count(*) FILTER (status = 'Concordant') AS concordant, count(*) FILTER (status = 'OnlyPipelineA') AS only_a, count(*) FILTER (status = 'OnlyPipelineB') AS only_b,
    count(*) FILTER (status = 'DiscordantAllele') AS discordant_allele, count(*) FILTER (status = 'OnlyPipelineA' AND in_gap) AS a_only_in_gaps, count(*) FILTER (status = 'OnlyPipelineB' AND in_gap) AS b_only_in_gaps,
    count(*) FILTER (status = 'Concordant') / CAST(count(*) AS DOUBLE) * 100 AS concordance_rate
  FROM cg GROUP BY sample
)"""


def callset_positions(v):
    call = v.once("calls", v.call).select("pipeline", "sample", F.concat(F.lit("c"), (F.col("pos") % 3).cast("string")).alias("chrom"), "pos", "alt", "qual", F.col("dp").alias("depth"), ((F.col("pos") % 10).cast("double") / 10).alias("af"))
    a, b = call.where("pipeline = 'p1'"), call.where("pipeline = 'p2'")
    return callsets.positions(a, b, iv.merge(v.gap().where("pipeline = 'gt'"), PS), "p1", "p2")


@query(
    "callset_positions",
    """ SELECT sample, chrom, pos, a_alt, b_alt, status, in_gap, CASE status WHEN 'Concordant' THEN NULL WHEN 'DiscordantAllele' THEN 'Different alleles called' ELSE
      coalesce(nullif(concat_ws('; ', CASE WHEN in_gap THEN 'In gap region (low coverage)' END, CASE WHEN coalesce(a_depth, b_depth) < 10 THEN 'Low read depth (<10)' END,
        CASE WHEN coalesce(a_qual, b_qual) < 100 THEN 'Low quality score (<100)' END, CASE WHEN coalesce(a_af, b_af) < 0.9 THEN 'Allele frequency <90%' END), ''), 'Pipeline-specific filter or algorithm difference') END AS likely_cause FROM cg""",
    CALLSET,
)
def callset_positions_query(v):
    return callset_positions(v).select("sample", "chrom", "pos", "a_alt", "b_alt", "status", "in_gap", "likely_cause")


@query("callset_per_sample", " SELECT * FROM cps", CALLSET)
def callset_per_sample(v):
    return callsets.per_sample(callset_positions(v))


@query(
    "callset_totals",
    """ SELECT count(*) AS num_samples, CAST(sum(greatest(snps_a, snps_b)) AS BIGINT) AS total_positions, CAST(sum(concordant) AS BIGINT) AS concordant, CAST(sum(only_a) AS BIGINT) AS only_a, CAST(sum(only_b) AS BIGINT) AS only_b,
      CAST(sum(a_only_in_gaps) AS BIGINT) AS a_only_in_gaps, CAST(sum(b_only_in_gaps) AS BIGINT) AS b_only_in_gaps, CAST(0 AS BIGINT) AS discordant_allele, sum(concordant) / CAST(sum(greatest(snps_a, snps_b)) AS DOUBLE) * 100 AS concordance_rate FROM cps""",
    CALLSET,
)
def callset_totals(v):
    return callsets.totals(callset_per_sample(v), "p1", "p2").drop("interpretation")


@query("callset_top_missed", " SELECT sample, chrom, pos, a_alt, a_qual FROM cg WHERE status = 'OnlyPipelineA' AND a_qual > 100 AND a_depth > 10 ORDER BY a_qual DESC, sample, chrom, pos LIMIT 50", CALLSET)
def callset_top_missed(v):
    return callsets.top_missed(callset_positions(v), "a").select("sample", "chrom", "pos", "a_alt", "a_qual")


@query("callset_page", " SELECT sample, chrom, pos, status, (SELECT count(*) FROM cg WHERE sample = 'S1' AND status = 'OnlyPipelineB') AS total FROM cg WHERE sample = 'S1' AND status = 'OnlyPipelineB' ORDER BY sample, chrom, pos LIMIT 20 OFFSET 40", CALLSET)
def callset_page(v):
    return callsets.page(callset_positions(v), 2, 20, "S1", "OnlyPipelineB").select("sample", "chrom", "pos", "status", "total")


@query("snp_retention", " SELECT c.sample, count(*) AS total_snps, count(g.pos) AS snps_in_gaps, count(*) - count(g.pos) AS snps_retained, (count(*) - count(g.pos)) / CAST(count(*) AS DOUBLE) * 100 AS retention_pct FROM snp c LEFT JOIN (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'gt') g USING (sample, pos) WHERE c.pipeline = 'p1' GROUP BY c.sample")
def snp_retention(v):
    return callsets.retention(snps(v).where("pipeline = 'p1'").select("sample", "pos"), merged(v).where("pipeline = 'gt'"))


@query(
    "filtered_concordance",
    """, a AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p1'), b AS (SELECT DISTINCT sample, pos FROM gp WHERE pipeline = 'p2'),
    x AS (SELECT coalesce(a.sample, b.sample) AS sample, count(a.pos) AS na, count(b.pos) AS nb, count(a.pos) FILTER (b.pos IS NOT NULL) AS c FROM a FULL JOIN b ON a.sample = b.sample AND a.pos = b.pos GROUP BY 1)
    SELECT sample, na AS gap_bases, nb AS filtered_bases, c AS concordant_bases, na - c AS gap_only_bases, nb - c AS filtered_only_bases, c / CAST(na + nb - c AS DOUBLE) * 100 AS concordance_pct FROM x""",
)
def filtered_concordance(v):
    g = merged(v)
    return callsets.compare_filtered(g.where("pipeline = 'p1'").drop("pipeline"), g.where("pipeline = 'p2'").drop("pipeline"))


@query("core_difference", """, g AS (SELECT sample, count(DISTINCT pos) AS b FROM gp WHERE pipeline = 'p1' GROUP BY sample), s AS (SELECT 'S' || CAST(range AS VARCHAR) AS sample, n - 100 * range AS aligned, 90 * range AS lowcov FROM range(6), n)
    SELECT sample, n - b AS core_size, b AS gap_bases, n - b - aligned AS core_diff, (n - b - aligned) / CAST(n AS DOUBLE) * 100 AS core_diff_pct, greatest(b - lowcov, 0) AS gaps_not_lowcov, greatest(lowcov - b, 0) AS lowcov_not_in_gaps FROM g JOIN s USING (sample), n""")
def core_difference(v):
    n = v.ref_len
    stats = v.spark.range(6).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sample"), (F.lit(n) - 100 * F.col("id")).alias("aligned"), (90 * F.col("id")).alias("lowcov"))
    return callsets.core_difference(merged(v).where("pipeline = 'p1'"), stats, n)


@query("alignment_validation", """, o AS (SELECT 'c' AS chrom, pos, sample, CASE WHEN pos % 5 = 0 THEN NULL ELSE alt END AS base FROM call WHERE pipeline = 'gt')
    SELECT chrom, pos, count(base) AS samples, count(DISTINCT base) AS bases, CASE WHEN count(base) = 0 THEN 'no_data' WHEN count(base) >= 2 AND count(DISTINCT base) = 1 THEN 'artifact' ELSE 'real' END AS verdict FROM o GROUP BY chrom, pos""")
def alignment_validation(v):
    o = v.call().where("pipeline = 'gt'").select(F.lit("c").alias("chrom"), "pos", "sample", F.when(F.col("pos") % 5 != 0, F.col("alt")).alias("base"))
    return callsets.validate(o)


# Distances

DIST = """al AS (SELECT pos, sample, CASE WHEN pos % 7 = 0 THEN 'N' ELSE alt END AS allele FROM call WHERE pipeline = 'p1'), pr AS (SELECT a.sample AS a, b.sample AS b FROM smp a JOIN smp b ON a.sample < b.sample)"""


def alleles(v):
    return v.call().where("pipeline = 'p1'").select("pos", "sample", F.expr("CASE WHEN pos % 7 = 0 THEN 'N' ELSE alt END AS allele"))


@query("snp_distance", " SELECT pr.a, pr.b, count(*) FILTER (x.allele <> y.allele AND x.allele IN ('A','C','G','T') AND y.allele IN ('A','C','G','T')) AS distance FROM pr JOIN al x ON x.sample = pr.a LEFT JOIN al y ON y.sample = pr.b AND y.pos = x.pos GROUP BY ALL", DIST)
def snp_distance(v):
    return distances.hamming(alleles(v), v.samples())


@query("snp_comparable", " SELECT pr.a, pr.b, count(*) FILTER (x.allele <> 'N' AND y.allele <> 'N') AS comparable FROM pr JOIN al x ON x.sample = pr.a LEFT JOIN al y ON y.sample = pr.b AND y.pos = x.pos GROUP BY ALL", DIST)
def snp_comparable(v):
    return distances.comparable(alleles(v), v.samples())


@query("snp_distance_matrix", """, d AS (SELECT pr.a, pr.b, count(*) FILTER (x.allele <> y.allele AND x.allele <> 'N' AND y.allele <> 'N') AS distance FROM pr JOIN al x ON x.sample = pr.a LEFT JOIN al y ON y.sample = pr.b AND y.pos = x.pos GROUP BY ALL)
    SELECT a AS "row", b AS "col", distance FROM d UNION ALL SELECT b, a, distance FROM d UNION ALL SELECT sample, sample, 0 FROM smp""", DIST)
def snp_distance_matrix(v):
    return distances.square(snp_distance(v), v.samples())


# Features

FEAT = """gz AS (SELECT DISTINCT sample, s, e FROM gap WHERE pipeline = 'gt'), gm AS (
  SELECT sample, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT sample, pos, pos - row_number() OVER (PARTITION BY sample ORDER BY pos) AS g FROM gp WHERE pipeline = 'gt') GROUP BY sample, g),
ov AS (SELECT sample, gene AS name, feature_type, product, f.s AS fs, gm.s AS gs, least(f.e, gm.e) - greatest(f.s - 1, gm.s) AS overlap_bp, (least(f.e, gm.e) - greatest(f.s - 1, gm.s)) / CAST(f.e - f.s + 1 AS DOUBLE) * 100 AS overlap_pct
  FROM feature f JOIN gm ON f.s - 1 < gm.e AND gm.s < f.e),
af AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, name ORDER BY overlap_pct DESC, overlap_bp DESC, feature_type DESC, fs, gs) AS r FROM ov) WHERE r = 1)"""


def affected_features(v):
    return features.affected(v.feature().withColumn("name", F.col("gene")), merged(v).where("pipeline = 'gt'"))


@query("features_in_gaps", " SELECT sample, name, feature_type, product, overlap_bp, overlap_pct FROM af", FEAT)
def features_in_gaps(v):
    return affected_features(v).drop("start")


@query("gene_zones", """ SELECT m.sample, count(*) FILTER (feature_type = 'gene') AS affected_genes, count(*) FILTER (feature_type = 'CDS') AS affected_cds, count(*) FILTER (feature_type = 'gene' AND overlap_pct >= 99.9) AS removed_genes,
    count(*) FILTER (feature_type = 'gene' AND overlap_pct >= 50) AS significantly_affected FROM smp m LEFT JOIN af USING (sample) GROUP BY m.sample""", FEAT)
def gene_zones(v):
    return features.zones(affected_features(v), v.samples())


@query("gene_search", " SELECT sample, name, product FROM af WHERE sample = 'S2' AND (contains(lower(name), 'g1') OR contains(lower(product), 'brand#3'))", FEAT)
def gene_search(v):
    both = features.search(affected_features(v), "S2", "g1").union(features.search(affected_features(v), "S2", "Brand#3")).select("sample", "name", "product")
    return both.distinct()


# Quality control

QUAL = """own AS (SELECT m.sample, count(DISTINCT g.pos) AS n FROM smp m LEFT JOIN gp g ON g.pipeline = 'gt' AND g.sample = m.sample GROUP BY ALL),
sh AS (SELECT a.sample AS a, b.sample AS b, count(*) AS i FROM gp a JOIN gp b ON a.pos = b.pos AND a.sample < b.sample WHERE a.pipeline = 'gt' AND b.pipeline = 'gt' GROUP BY ALL),
pq AS (SELECT x.sample AS a, y.sample AS b, x.n - coalesce(i, 0) AS unique_a, y.n - coalesce(i, 0) AS unique_b, n.n - (x.n + y.n - coalesce(i, 0)) AS core, coalesce(i, 0) / CAST(x.n + y.n - coalesce(i, 0) AS DOUBLE) AS quality
  FROM own x JOIN own y ON x.sample < y.sample CROSS JOIN n LEFT JOIN sh ON sh.a = x.sample AND sh.b = y.sample),
pm AS (SELECT sample, avg(quality) AS avg_quality, CAST(sum(u) AS BIGINT) AS total_unique, CAST(sum(core) // count(*) AS BIGINT) AS avg_core, min(quality) AS min_quality
  FROM (SELECT a AS sample, quality, unique_a AS u, core FROM pq UNION ALL SELECT b, quality, unique_b, core FROM pq) GROUP BY sample),
nf AS (SELECT sample, count(*) AS n_contigs, CAST(max(total) AS BIGINT) AS total_length, max(length) FILTER (run >= total // 2) AS n50 FROM (
  SELECT *, sum(length) OVER (PARTITION BY sample ORDER BY length DESC, contig ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER (PARTITION BY sample) AS total FROM contig) GROUP BY sample),
mt AS (SELECT pm.sample, 0.9 + (nf.total_length % 100) / 1000.0::DOUBLE AS ref_identity, (n.n - own.n) / CAST(n.n AS DOUBLE) AS ref_coverage, avg_quality, n50, total_length, total_unique FROM pm JOIN nf USING (sample) JOIN own USING (sample), n),
md AS (SELECT list_sort(list(n50))[count(*) // 2 + 1] AS median_n50 FROM mt),
zs AS (SELECT mt.*, median_n50, CASE WHEN stddev_pop(ref_coverage) OVER () > 0 THEN (ref_coverage - avg(ref_coverage) OVER ()) / stddev_pop(ref_coverage) OVER () ELSE 0 END AS cz,
  CASE WHEN stddev_pop(avg_quality) OVER () > 0 THEN (avg_quality - avg(avg_quality) OVER ()) / stddev_pop(avg_quality) OVER () ELSE 0 END AS qz, total_unique / CAST(total_length AS DOUBLE) AS ur FROM mt, md),
sc AS (SELECT *, least(1.0, CASE WHEN ur > 0.005 AND ur <= 0.02 THEN 0.1 ELSE 0 END + CASE WHEN ref_identity < 0.95 THEN 0.3 ELSE 0 END + CASE WHEN ref_coverage < 0.9 THEN 0.2 ELSE 0 END + CASE WHEN avg_quality < 0.3 THEN 0.25 ELSE 0 END
  + CASE WHEN cz < -2 THEN 0.2 ELSE 0 END + CASE WHEN qz < -2 THEN 0.2 ELSE 0 END + CASE WHEN median_n50 > 0 AND n50 < median_n50 // 2 THEN 0.15 ELSE 0 END + CASE WHEN ur > 0.02 THEN 0.3 ELSE 0 END) AS score,
  concat_ws(',', CASE WHEN ref_identity < 0.95 THEN 'LowIdentity' END, CASE WHEN ref_coverage < 0.9 THEN 'LowCoverage' END, CASE WHEN avg_quality < 0.3 THEN 'HighUnaligned' END, CASE WHEN cz < -2 THEN 'IdentityOutlier' END,
    CASE WHEN qz < -2 THEN 'UnalignedOutlier' END, CASE WHEN median_n50 > 0 AND n50 < median_n50 // 2 THEN 'HighFragmentation' END, CASE WHEN ur > 0.02 THEN 'LowRefIdentity' END) AS flags FROM zs)"""


def gt_gaps(v):
    return merged(v).where("pipeline = 'gt'").drop("pipeline")


def gt_pairs(v):
    return qc.pairwise_gaps(gt_gaps(v), v.samples(), [], v.ref_len)


@query("pair_metrics", " SELECT * FROM pm", QUAL)
def pair_metrics(v):
    return qc.pair_metrics(gt_pairs(v), v.samples(), [])


@query("dataset_quality", " SELECT avg(quality) AS mean_quality, min(quality) AS min_quality, max(quality) AS max_quality, (SELECT a || '-' || b FROM pq ORDER BY quality, a, b LIMIT 1) AS worst_pair, (SELECT a || '-' || b FROM pq ORDER BY quality DESC, a, b LIMIT 1) AS best_pair, count(*) FILTER (quality > 0.8) AS high_quality_pairs, count(*) FILTER (quality < 0.2) AS low_quality_pairs FROM pq", QUAL)
def dataset_quality(v):
    return qc.dataset_quality(gt_pairs(v), [])


@query("contig_n50", " SELECT * FROM nf", QUAL)
def contig_n50(v):
    return qc.n50(v.contig())


@query("contig_offsets", """ SELECT sample, contig, contig_idx, length, CAST(coalesce(sum(length) OVER (PARTITION BY sample ORDER BY contig_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM contig""")
def contig_offsets(v):
    return iv.offsets(v.contig())


def metrics(v):
    n = v.ref_len
    own = v.samples().join(gt_gaps(v).groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("g")), "sample", "left")
    m = pair_metrics(v).join(contig_n50(v), "sample").join(own, "sample")
    return m.select("sample", (0.9 + (F.col("total_length") % 100) / F.lit(1000.0)).alias("ref_identity"), ((F.lit(n) - F.coalesce("g", F.lit(0))) / F.lit(float(n))).alias("ref_coverage"), "avg_quality", "n50", "total_length", "total_unique")


@query("sample_scores", " SELECT sample, round(score, 6)::DOUBLE AS score, flags, CASE WHEN score >= 0.5 THEN 'EXCLUDE' WHEN score >= 0.2 OR flags <> '' THEN 'REVIEW' ELSE 'OK' END AS recommendation FROM sc", QUAL)
def sample_scores(v):
    return qc.score(metrics(v), 0.95).select("sample", F.round("score", 6).alias("score"), F.array_join("flags", ",").alias("flags"), "recommendation")


@query("qc_summary", " SELECT count(*) AS total, count(*) FILTER (score < 0.2 AND flags = '') AS ok, count(*) FILTER (score < 0.5 AND (score >= 0.2 OR flags <> '')) AS review, count(*) FILTER (score >= 0.5) AS exclude, avg(ref_coverage) AS avg_coverage, min(ref_coverage) AS min_coverage FROM sc", QUAL)
def qc_summary(v):
    return qc.summary(qc.score(metrics(v), 0.95))


def spread(v):
    """Coverage that differs enough for tiers and outliers."""
    m = metrics(v).select("sample", (F.lit(0.88) + F.substring("sample", 2, 1).cast("int") * F.lit(0.025)).alias("ref_coverage"), "avg_quality")
    return m.crossJoin(F.broadcast(dataset_quality(v).select("mean_quality")))


SPREAD = QUAL + """, sp AS (SELECT sample, CAST(0.88 AS DOUBLE) + CAST(substr(sample, 2, 1) AS INT) * CAST(0.025 AS DOUBLE) AS ref_coverage, avg_quality, (SELECT avg(quality) FROM pq) AS mean_quality FROM mt),
ol AS (SELECT sample, CASE WHEN ref_coverage < 0.9 THEN 'Major' WHEN ref_coverage < 0.95 THEN 'Moderate' WHEN avg_quality < 0.2 AND mean_quality > 0.5 THEN 'Major' WHEN avg_quality < mean_quality - 0.3 THEN 'Moderate' END AS severity FROM sp)"""


@query("outliers", " SELECT * FROM ol WHERE severity IS NOT NULL", SPREAD)
def outliers(v):
    return qc.outliers(spread(v)).select("sample", "severity")


@query("clusters", """, t AS (SELECT *, CASE WHEN ref_coverage >= 0.99 THEN 0 WHEN ref_coverage >= 0.95 THEN 1 WHEN ref_coverage >= 0.9 THEN 2 ELSE 3 END AS t FROM sp)
    SELECT row_number() OVER (ORDER BY t) - 1 AS id, ['HighCoverage', 'GoodCoverage', 'ModerateCoverage', 'LowCoverage'][t + 1] AS cluster_type, count(*) AS n_samples, min(ref_coverage) AS min_coverage, avg(ref_coverage) AS avg_coverage, avg(avg_quality) AS avg_quality FROM t GROUP BY t HAVING count(*) > 1""", SPREAD)
def clusters(v):
    return qc.clusters(spread(v))


@query("cluster_pattern", """ SELECT CASE WHEN (SELECT count(*) FROM sp) < 2 THEN 'Insufficient' WHEN (SELECT count(*) FROM sp WHERE ref_coverage < 0.95) = 0 AND (SELECT count(severity) FROM ol) = 0 THEN 'AllHighCoverage'
    WHEN (SELECT count(*) FROM sp WHERE ref_coverage >= 0.95) > 0 AND (SELECT count(*) FROM ol WHERE severity = 'Major') > 0 THEN 'HighCoverageWithOutliers'
    WHEN (SELECT count(*) FROM pq WHERE quality < 0.2) > (SELECT count(*) FROM pq WHERE quality > 0.8) THEN 'HighGapDiversity' ELSE 'VariableCoverage' END AS pattern""", SPREAD)
def cluster_pattern(v):
    return qc.pattern(spread(v), qc.outliers(spread(v)), dataset_quality(v))


@query("gap_impact", """, un AS (SELECT sample, count(*) FILTER (k = 1) AS u, count(*) FILTER (k > 1) AS s FROM gp JOIN gk USING (pipeline, pos) WHERE pipeline = 'gt' GROUP BY sample)
    SELECT own.sample, own.n AS gap_bases, coalesce(u, 0) AS unique_bases, coalesce(s, 0) AS shared_bases, coalesce(u, 0) / CAST(n.n AS DOUBLE) * 100 AS core_loss_pct,
      CASE WHEN coalesce(u, 0) / CAST(n.n AS DOUBLE) * 100 > 5 THEN 'Critical' WHEN coalesce(u, 0) / CAST(n.n AS DOUBLE) * 100 > 2 THEN 'High' WHEN coalesce(u, 0) / CAST(n.n AS DOUBLE) * 100 > 0.5 OR avg_quality < 0.3 THEN 'Medium' ELSE 'Low' END AS risk
    FROM own LEFT JOIN un USING (sample) LEFT JOIN pm USING (sample), n""", QUAL)
def gap_impact(v):
    return qc.impact(gt_gaps(v), v.samples(), pair_metrics(v), v.ref_len)


@query("coverage_thresholds", f""", cov AS (SELECT p.pipeline, {N} - coalesce(k, 0) AS c, count(*) AS m FROM pipe p CROSS JOIN ref_base r LEFT JOIN gk ON gk.pipeline = p.pipeline AND gk.pos = r.pos GROUP BY ALL),
    th AS (SELECT unnest([100.0, 95.0, 90.0, 80.0, 70.0, 50.0, 25.0])::DOUBLE AS threshold)
    SELECT pipeline, threshold, CAST(greatest(ceil(threshold / 100 * {N}), 1) AS BIGINT) AS min_samples, CAST(coalesce(sum(m) FILTER (c >= greatest(ceil(threshold / 100 * {N}), 1)), 0) AS BIGINT) AS core_size, CAST(coalesce(sum(m) FILTER (c < greatest(ceil(threshold / 100 * {N}), 1)), 0) AS BIGINT) AS empty_size FROM cov CROSS JOIN th GROUP BY pipeline, threshold""")
def coverage_thresholds(v):
    return qc.thresholds(merged(v), pipelines(v), ["pipeline"], N, v.ref_len)


@query("sample_coverage_histogram", f""", cov AS (SELECT p.pipeline, {N} - coalesce(k, 0) AS covered FROM pipe p CROSS JOIN ref_base r LEFT JOIN gk ON gk.pipeline = p.pipeline AND gk.pos = r.pos)
    SELECT p.pipeline, CAST(x.range AS BIGINT) AS covered, count(c.covered) AS positions FROM pipe p CROSS JOIN range({N + 1}) x LEFT JOIN cov c ON c.pipeline = p.pipeline AND c.covered = x.range GROUP BY ALL""")
def sample_coverage_histogram(v):
    return qc.full_histogram(merged(v), pipelines(v), ["pipeline"], N, v.ref_len)


@query("fragile_regions", f""", lo AS (SELECT pipeline, pos, k, pos - row_number() OVER (PARTITION BY pipeline ORDER BY pos) AS g FROM gk WHERE {N} - k < ceil(0.5 * {N})),
    rg AS (SELECT pipeline, min(pos) AS s, max(pos) + 1 AS e, min(k) AS mk FROM lo GROUP BY pipeline, g HAVING count(*) >= 100)
    SELECT r.pipeline, r.s AS start, r.e AS "end", {N} - mk AS max_coverage, ({N} - mk) / {N}::DOUBLE * 100 AS max_coverage_pct,
      (SELECT string_agg(DISTINCT gp.sample, ',' ORDER BY gp.sample) FROM gp WHERE gp.pipeline = r.pipeline AND gp.pos >= r.s AND gp.pos < r.e) AS samples FROM rg r""")
def fragile_regions(v):
    return qc.fragile_regions(merged(v), ["pipeline"], N, 100)


EMPTY = f"""th AS (SELECT unnest([100.0, 95.0, 90.0, 80.0, 70.0, 50.0, 25.0])::DOUBLE AS threshold), tm AS (SELECT threshold, CAST(greatest(ceil(threshold / 100 * {N}), 1) AS BIGINT) AS min_samples FROM th),
em AS (SELECT pipeline, threshold, min_samples, pos, pos - row_number() OVER (PARTITION BY pipeline, threshold ORDER BY pos) AS g FROM gk JOIN tm ON {N} - k < min_samples),
er AS (SELECT pipeline, threshold, min_samples, min(pos) AS start, max(pos) + 1 AS "end" FROM em GROUP BY pipeline, threshold, min_samples, g)"""


def empty_regions(v):
    return qc.empty_regions(merged(v), pipelines(v), ["pipeline"], N)


@query("threshold_empty_regions", " SELECT * FROM er", EMPTY)
def threshold_empty_regions(v):
    """The empty regions of all thresholds."""
    return empty_regions(v)


@query(
    "threshold_summary",
    """ SELECT p.pipeline, t.threshold, t.min_samples, CAST(n.n - coalesce(sum(er."end" - er.start), 0) AS BIGINT) AS core_size, (n.n - coalesce(sum(er."end" - er.start), 0)) / n.n::DOUBLE * 100 AS core_pct,
      CAST(coalesce(sum(er."end" - er.start), 0) AS BIGINT) AS empty_size, count(er.start) AS regions, coalesce(max(er."end" - er.start), 0) AS longest
    FROM pipe p CROSS JOIN tm t CROSS JOIN n LEFT JOIN er ON er.pipeline = p.pipeline AND er.threshold = t.threshold GROUP BY p.pipeline, t.threshold, t.min_samples, n.n""",
    EMPTY,
)
def threshold_summary(v):
    return qc.threshold_summary(empty_regions(v), pipelines(v), ["pipeline"], N, v.ref_len)


# The first reader version

V1 = f"""c1 AS (SELECT c.*, r.base FROM call c JOIN ref_base r USING (pos)), pn AS (SELECT pipeline, count(DISTINCT sample) AS n FROM call GROUP BY pipeline),
co AS (SELECT c.pipeline, c.pos, count(DISTINCT alt) = 1 AND count(*) FILTER (alt = base) = 0 AS cons FROM c1 c JOIN pn USING (pipeline) GROUP BY c.pipeline, c.pos, pn.n HAVING count(DISTINCT sample) = pn.n),
gg AS (SELECT DISTINCT pos FROM gp WHERE pipeline = 'gt')"""


@query(
    "v1_kpis",
    """ SELECT p.pipeline, (SELECT count(*) FROM snp s WHERE s.pipeline = p.pipeline) AS snps, (SELECT CAST(coalesce(sum(e - s), 0) AS BIGINT) FROM gap g WHERE g.pipeline = p.pipeline AND e > s) AS gaps,
      (SELECT count(*) FROM co WHERE co.pipeline = p.pipeline) AS core_snps, (SELECT count(*) FROM co WHERE co.pipeline = p.pipeline AND cons) AS consensus_snps,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM call t WHERE t.pipeline = 'gt' AND NOT EXISTS (SELECT 1 FROM call c WHERE c.pipeline = p.pipeline AND c.sample = t.sample AND c.pos = t.pos)) END AS gt_snps_missing,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM call t WHERE t.pipeline = 'gt' AND EXISTS (SELECT 1 FROM call c WHERE c.pipeline = p.pipeline AND c.sample = t.sample AND c.pos = t.pos)) END AS gt_snps_called,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM co t WHERE t.pipeline = 'gt' AND NOT EXISTS (SELECT 1 FROM co c WHERE c.pipeline = p.pipeline AND c.pos = t.pos)) END AS core_gt_missing,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM co t WHERE t.pipeline = 'gt' AND t.cons AND NOT EXISTS (SELECT 1 FROM co c WHERE c.pipeline = p.pipeline AND c.cons AND c.pos = t.pos)) END AS consensus_gt_missing,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM call c WHERE c.pipeline = p.pipeline AND EXISTS (SELECT 1 FROM gp WHERE gp.pipeline = 'gt' AND gp.sample = c.sample AND gp.pos = c.pos)) END AS snps_in_gt_gaps_total,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM co c JOIN gg USING (pos) WHERE c.pipeline = p.pipeline) END AS snps_in_gt_gaps_core,
      CASE WHEN p.pipeline <> 'gt' THEN (SELECT count(*) FROM co c JOIN gg USING (pos) WHERE c.pipeline = p.pipeline AND cons) END AS snps_in_gt_gaps_consensus FROM pipe p""",
    V1,
)
def v1_kpis(v):
    return reader_v1.kpis(v.call(reader_v1.BIN), iv.nonempty(v.gap()), v.ref_base(), pipelines(v), "gt", v.carriers(), v.parts)


@query("v1_concordance", """ SELECT x.pipeline AS a, y.pipeline AS b, (SELECT count(*) FROM call a JOIN call b ON a.sample = b.sample AND a.pos = b.pos AND a.pipeline = x.pipeline AND b.pipeline = y.pipeline) AS shared,
    (SELECT count(*) FROM call a JOIN call b ON a.sample = b.sample AND a.pos = b.pos AND a.alt = b.alt AND a.pipeline = x.pipeline AND b.pipeline = y.pipeline) AS same_allele,
    (SELECT count(*) FROM call a WHERE a.pipeline = x.pipeline AND NOT EXISTS (SELECT 1 FROM call b WHERE b.pipeline = y.pipeline AND a.sample = b.sample AND a.pos = b.pos)) AS only_a,
    (SELECT count(*) FROM call b WHERE b.pipeline = y.pipeline AND NOT EXISTS (SELECT 1 FROM call a WHERE a.pipeline = x.pipeline AND a.sample = b.sample AND a.pos = b.pos)) AS only_b FROM pipe x JOIN pipe y ON x.pipeline < y.pipeline""")
def v1_concordance(v):
    return reader_v1.pipeline_concordance(v.call())


@query("v1_region", """ SELECT 'snp' AS kind, pipeline, sample, pos AS start, pos AS "end", alt FROM call WHERE pos BETWEEN 100 AND 400
    UNION ALL SELECT 'gap', pipeline, sample, greatest(s, 100), least(e, 400), NULL FROM runs WHERE e >= 100 AND s <= 400""", ISLAND)
def v1_region(v):
    return reader_v1.region(v.call(), merged(v), 100, 400)


@query("v1_filtered_positions", """, f AS (SELECT pos, pipeline, count(DISTINCT sample) AS m FROM call GROUP BY ALL HAVING count(DISTINCT sample) = 6)
    SELECT f.pos, count(*) AS n_all FROM f GROUP BY f.pos HAVING count(*) < 3 AND f.pos IN (SELECT pos FROM gp WHERE pipeline = 'gt')""")
def v1_filtered_positions(v):
    return reader_v1.filter_positions(v.call(), merged(v), ["gt", "p1", "p2"], N, ["discord", "gaps:gt"])


V1S = f"""vt AS (SELECT r.pos, count(DISTINCT coalesce(s.alt, '.')) = 1 AS agree FROM ref_base r CROSS JOIN smp m LEFT JOIN snp s ON s.pipeline = 'gt' AND s.sample = m.sample AND s.pos = r.pos GROUP BY r.pos),
vv AS (SELECT unnest(['strict', 'relaxed']) AS variant),
vd AS (SELECT d.*, variant, count(*) FILTER (gapped) OVER (PARTITION BY pipeline, pos, variant) AS k FROM dense d CROSS JOIN vv),
va1 AS (SELECT pipeline, variant, pos, k, coalesce(alt, '.') AS v, count(*) AS c FROM vd WHERE CASE variant WHEN 'strict' THEN k = 0 ELSE k < {N} AND NOT gapped END GROUP BY ALL),
vs AS (SELECT pipeline, variant, pos, k, sum(c) AS a, count(*) AS kinds, max(c) AS mx, count(*) FILTER (v <> '.') AS alts, coalesce(sum(c) FILTER (v = '.'), 0) AS nn FROM va1 GROUP BY ALL),
vc AS (SELECT vs.*, variant = 'strict' OR a >= 2 AS en, agree AND pipeline <> 'gt' AS ag, alts = 1 AND nn = 0 AS cons, a >= 3 AND mx = a - 1 AND kinds = 2 AS mj FROM vs JOIN vt USING (pos)),
vf AS (SELECT *, en AND NOT cons AND (alts > 0 OR variant = 'strict') AS disc FROM vc)"""


@query(
    "v1_global_stats",
    f""" SELECT f.pipeline, f.variant, CAST((SELECT n FROM n) - (SELECT count(*) FROM gk WHERE gk.pipeline = f.pipeline AND (f.variant = 'strict' OR gk.k = {N})) AS BIGINT) AS usable_space, count(*) AS total_snps, count(*) FILTER (en AND cons) AS consensus_snps,
      count(*) FILTER (disc) AS discriminating_snps, count(*) FILTER (disc AND k > 0) AS gap_affected, count(*) FILTER (disc AND k = 0 AND ag) AS gt_consensus, count(*) FILTER (disc AND k = 0 AND NOT ag AND mj) AS majority_rule,
      count(*) FILTER (disc AND k = 0 AND NOT ag AND NOT mj) AS confirmed, count(*) FILTER (en AND alts > 0 AND nn > 0) AS missing_calls FROM vf f GROUP BY f.pipeline, f.variant""",
    V1S,
)
def v1_global_stats(v):
    calls = v.once("snps", lambda: snps(v))
    return reader_v1.global_stats(sites.site_table(calls, merged(v), N, v.cover()), merged(v), calls, "gt", N, v.ref_len)


@query("what_if_core", """, a AS (SELECT pos, count(DISTINCT sample) AS k, min(sample) AS s FROM gp WHERE pipeline = 'gt' GROUP BY pos)
    SELECT 'unique' AS kind, CAST((SELECT n FROM n) - count(*) AS BIGINT) AS core FROM a WHERE k = 1 AND s IN ('S1', 'S2') UNION ALL
    SELECT 'all', CAST((SELECT n FROM n) - count(DISTINCT pos) AS BIGINT) FROM gp WHERE pipeline = 'gt' AND sample IN ('S1', 'S2')""")
def what_if_core(v):
    g = gt_gaps(v)
    one = lambda kind, unique: viewer.what_if_core(g, ["S1", "S2"], v.ref_len, unique).select(F.lit(kind).alias("kind"), "core")
    return one("unique", True).union(one("all", False))


@query("all_sample_kpis", """, f AS (SELECT pipeline, pos FROM call WHERE pipeline <> 'gt' GROUP BY ALL HAVING count(DISTINCT sample) = 6)
    SELECT count(*) FILTER (pipeline = 'p1') AS all_a, count(*) FILTER (pipeline = 'p2') AS all_b, count(*) FILTER (pipeline = 'p1' AND pos IN (SELECT pos FROM f WHERE pipeline = 'p2')) AS both FROM f""")
def all_sample_kpis(v):
    c = v.call().where("pipeline != 'gt'").withColumn("pipeline", F.when(F.col("pipeline") == "p1", "a").otherwise("b"))
    return viewer.all_sample_kpis(c, N)


@query("pair_bands", " SELECT a, b, (n.n - core) / CAST(n.n AS DOUBLE) * 100 AS reduction_pct, CASE WHEN quality >= 0.8 THEN 'high' WHEN quality >= 0.5 THEN 'good' WHEN quality >= 0.2 THEN 'moderate' ELSE 'low' END AS band FROM pq, n WHERE (n.n - core) / CAST(n.n AS DOUBLE) * 100 > 5", QUAL)
def pair_bands(v):
    return viewer.filter_pairs(gt_pairs(v), v.ref_len, 5).select("a", "b", "reduction_pct", "band")
