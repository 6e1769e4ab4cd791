"""Queries of sequences, conversions, report files, BED sets, pileups, sorted pages and shown values.

Files are made of the star-schema tables, written into the shared folder and read by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import alignments, callsets, features, qc, viewer
from gapweave.plans import convert
from gapweave.plans import queries as core
from gapweave.plans import text_queries as lines
from gapweave.plans.compare import Comparison
from gapweave.plans.views import Views, oracle
from gapweave.sources import datasource, fasta, report, sinks, text
from gapweave.sources.store import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, *ctes: str, plain: bool = True):
    """Registers a query and its SQL, which stands on the tables alone unless it is not ``plain``."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        ORACLES[name] = sql if plain else oracle(sql, *ctes)
        return f

    return add


def in_order(v: Views, rows: DataFrame, name: str) -> str:
    """Writes the column ``value`` as text, in files whose names are in the order of the other columns, and gives the folder."""
    path = shared_path(v.spark, name)
    by = [c for c in rows.columns if c != "value"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.text(path)
    return path


# Sequences

_RECORDS = "SELECT CAST(s_suppkey AS INT) AS c, repeat('ACGTN', CAST(1 + s_suppkey % 50 AS INT)) AS q FROM supplier"


def records(v: Views) -> DataFrame:
    """Chunks of a contig for each supplier."""
    return fasta.cut(v.table("supplier").selectExpr("'s' AS sample", "concat('c', s_suppkey) AS contig", "CAST(s_suppkey AS INT) AS contig_idx", "repeat('ACGTN', CAST(1 + s_suppkey % 50 AS INT)) AS sequence"))


@query("fasta_export_lines", f"SELECT CAST(c AS BIGINT) AS contig_idx, CAST(i AS BIGINT) AS line, substr(q, 60 * i + 1, 60) AS value FROM (SELECT *, unnest(range(0, (length(q) + 59) // 60)) AS i FROM ({_RECORDS})) UNION ALL SELECT -1, 0, '>ref'")
def fasta_export_lines(v):
    """The lines of the exported record: each contig is wrapped on its own."""
    return fasta.lines(records(v), "ref")


@query("fasta_round_trip", f"WITH w AS (SELECT string_agg(q, '' ORDER BY c) AS q FROM ({_RECORDS})) SELECT CAST(k AS BIGINT) AS k, md5(substr(q, 1000 * k + 1, 1000)) AS digest FROM (SELECT q, unnest(range(0, (length(q) + 999) // 1000)) AS k FROM w)")
def fasta_round_trip(v):
    """The record is written to many files and read again as one; digests of each 1,000 bases."""
    path = shared_path(v.spark, "export")
    fasta.write(records(v), "ref", path)
    again = fasta.chunks(v.spark, path, joined=True)
    return fasta.pieces(again, "at", 1000, []).select("k", F.md5("bases").alias("digest"))


@query("fasta_index_line", f"SELECT 'ref' || chr(9) || sum(length(q)) || chr(9) || '5' || chr(9) || '60' || chr(9) || '61' AS value FROM ({_RECORDS})")
def fasta_index_line(v):
    return fasta.index(records(v), "ref")


_TWINS = "SELECT s_suppkey AS s, repeat('acg', CAST(1 + s_suppkey % 20 AS INT)) AS x, repeat('TT', CAST(1 + s_suppkey % 10 AS INT)) AS y FROM supplier"


@query(
    "content_duplicates",
    f"WITH d AS (SELECT s, md5(concat(least(a, b), greatest(a, b))) AS digest FROM (SELECT s, md5(md5(upper(x))) AS a, md5(md5(y)) AS b FROM ({_TWINS}))) SELECT lpad(CAST(s AS VARCHAR), 9, '0') AS sample, digest, s = min(s) OVER (PARTITION BY digest) AS keep FROM d",
)
def content_duplicates(v):
    """Samples of the same two contigs, in either order and case."""
    turn = "s_suppkey % 2 = 0"
    x, y = "repeat('acg', CAST(1 + s_suppkey % 20 AS INT))", "repeat('TT', CAST(1 + s_suppkey % 10 AS INT))"
    both = v.table("supplier").selectExpr("lpad(CAST(s_suppkey AS STRING), 9, '0') AS sample", f"posexplode(IF({turn}, array({x}, {y}), array(upper({y}), upper({x})))) AS (contig_idx, sequence)")
    return qc.content_duplicates(both)


@query(
    "duplicate_groups",
    f"WITH d AS (SELECT s, least(a, b) || greatest(a, b) AS d FROM (SELECT s, md5(upper(x)) AS a, md5(y) AS b FROM ({_TWINS}))) SELECT lpad(CAST(min(s) AS VARCHAR), 9, '0') AS sample, count(*) AS n, string_agg(lpad(CAST(s AS VARCHAR), 9, '0'), ',' ORDER BY s) AS samples FROM d GROUP BY d",
)
def duplicate_groups(v):
    return qc.duplicate_groups(content_duplicates(v))


# Conversions.  Letters of sample i at the place of an order.

_LETTER = "substr('ACGTN-', CAST(1 + (o_custkey + {i} * (o_orderkey % 3)) % 6 AS INT), 1)"
_BASE = "substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1)"
_SIX = "SELECT o_orderkey AS p, u.i, " + _LETTER.format(i="u.i") + " AS a, " + _BASE + " AS r FROM orders, (SELECT unnest(range(6)) AS i) u"
_HAMMING = "SELECT x.s AS a, y.s AS b, CAST(count(*) FILTER (x.l <> y.l AND x.l IN ('A', 'C', 'G', 'T') AND y.l IN ('A', 'C', 'G', 'T')) AS BIGINT) AS distance FROM l x JOIN l y ON x.p = y.p AND x.s < y.s GROUP BY ALL"


def letters(v: Views) -> DataFrame:
    """(p, i, a, r) the six samples' letters, and the base, of each order."""
    return v.table("orders").select(F.col("o_orderkey").alias("p"), F.expr(_BASE).alias("r"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(_LETTER.format(i=i)).alias("a")) for i in range(6)])).alias("x")).select("p", "r", "x.i", "x.a")


def sequence_lines(rows: DataFrame, title: str, letter: str) -> DataFrame:
    """(title, k, value) FASTA lines of 70 letters in the order of p under a line for each title."""
    joint = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", letter))), lambda x: x[letter]), "")
    body = rows.groupBy(F.expr(title).alias("title"), F.expr("p div 70").alias("k")).agg(joint.alias("value"))
    heads = rows.select(F.expr(title).alias("title")).distinct().select("title", F.lit(-1).cast("long").alias("k"), F.concat(F.lit(">"), "title").alias("value"))
    return heads.unionByName(body)


@query("alignment_to_core", f"SELECT 'c' || (p % 2) AS chrom, p + 4 AS pos, r AS ref, 'S' || i AS sample, a AS allele FROM ({_SIX})")
def alignment_to_core(v):
    """A position list, a reference and an alignment of six samples, zipped by place."""
    rows = letters(v)
    listed = in_order(v, v.table("orders").selectExpr("o_orderkey AS p", "concat_ws('\t', concat('c', o_orderkey % 2), o_orderkey + 5, 1, 's') AS value"), "list.txt")
    ref = in_order(v, sequence_lines(rows.where("i = 0"), "'reference'", "r"), "reference.fa")
    aligned = in_order(v, sequence_lines(rows, "concat('S', i)", "a"), "aligned.fa")
    return convert.alignment_to_core(v.spark, listed, ref, aligned).drop("pipeline")


@query("nexus_to_distances", f"WITH l AS (SELECT p, 'S' || i AS s, a AS l FROM ({_SIX})) {_HAMMING}")
def nexus_to_distances(v):
    """A matrix between other blocks; rows of its form before and behind it don't count."""
    cells = F.concat_ws("\t", F.col("p").cast("string"), F.first("r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]), "\t"))
    rows = letters(v).groupBy("p").agg(cells.alias("value")).select(F.lit(1).alias("o"), "p", "value")
    stray = "7\tA\tA\tC\tG\tT\tA\tC"
    around = [(0, 0, "#NEXUS"), (0, 1, stray), (0, 2, "taxlabels\tREF\t" + "\t".join(f"S{i}" for i in range(6)) + ";"), (0, 3, "matrix"), (2, 0, ";"), (2, 1, "end;"), (2, 2, "begin other;"), (2, 3, stray), (2, 4, "end;")]
    path = in_order(v, rows.unionByName(v.spark.createDataFrame(around, "o int, p long, value string")), "x.nex")
    return convert.nexus_to_distances(v.spark, path)


def genotype_table(v: Views) -> str:
    t = v.table("orders").select("o_orderkey", F.expr(_BASE).alias("r"), F.concat_ws("\t", *[F.expr(f"CASE (o_custkey + {i}) % 5 WHEN 0 THEN './.' WHEN 1 THEN concat({_BASE}, '/G') WHEN 2 THEN 'T|T' WHEN 3 THEN '.|A' ELSE 'C' END") for i in range(6)]).alias("g"))
    rows = t.select(F.lit(1).alias("o"), F.col("o_orderkey").alias("p"), F.concat_ws("\t", F.lit("c1"), F.col("o_orderkey").cast("string"), "r", F.lit("T"), F.lit("SNP"), "g").alias("value"))
    head = v.spark.createDataFrame([(0, 0, "CHROM\tPOS\tREF\tALT\tTYPE\t" + "\t".join(f"S{i}.GT" for i in range(6)))], "o int, p long, value string")
    return in_order(v, head.unionByName(rows), "out.vcf.table")


_GT = "SELECT o_orderkey AS p, u.i, CASE (o_custkey + u.i) % 5 WHEN 0 THEN 'N' WHEN 1 THEN " + _BASE + " WHEN 2 THEN 'T' WHEN 3 THEN 'N' ELSE 'C' END AS a, " + _BASE + " AS r FROM orders, (SELECT unnest(range(6)) AS i) u"


@query("genotypes_to_core", f"SELECT 'c1' AS chrom, p - 1 AS pos, r AS ref, 'S' || i AS sample, a AS allele FROM ({_GT}) WHERE p >= 1")
def genotypes_to_core(v):
    return convert.convert(v.spark, "genotypes", "core", genotype_table(v)).drop("pipeline")


@query("core_to_distances", f"WITH l AS (SELECT p, 'S' || i AS s, a AS l FROM ({_GT}) WHERE p >= 1) {_HAMMING}")
def core_to_distances(v):
    """Genotypes to core alleles, written as a wide table, and that to distances."""
    names = [f"S{i}" for i in range(6)]
    wide = sinks.core_wide(genotypes_to_core(v), names)
    path = shared_path(v.spark, "core.tsv")
    sinks.tsv(wide, path, ["CHR", "POS"])
    return convert.convert(v.spark, "core", "distances", path)


@query("matrix_of_callers", "SELECT 'n' || a.n_nationkey AS row, 'n' || b.n_nationkey AS col, CAST(abs(a.n_nationkey - b.n_nationkey) AS BIGINT) AS distance FROM nation a, nation b")
def matrix_of_callers(v):
    """A distance matrix whose names end as a caller's folders do, read without the check of its shape."""
    n = v.table("nation").selectExpr("n_nationkey AS i")
    square = n.crossJoin(n.selectExpr("i AS j")).selectExpr("concat('n', i, '_snippy') AS row", "concat('n', j, '_snippy') AS col", "abs(i - j) AS distance")
    path = shared_path(v.spark, "matrix.tsv")
    sinks.matrix(square, sorted(r.row for r in square.select("row").distinct().collect()), path)
    return text.distance_matrix(v.spark, path, strict=False)


# Formats of Spark's own reader


@query("core_source_rows", f"SELECT 'c1' AS chrom, p - 1 AS pos, r AS ref, 'S' || i AS sample, a AS allele FROM ({_GT}) WHERE p - 1 >= 100 AND p - 1 < 9000 AND a <> 'N'")
def core_source_rows(v):
    """A core table as a format of spark.read: ranges of bytes, bounds of positions pushed to the source."""
    path = shared_path(v.spark, "core.tsv")
    wide = sinks.core_wide(genotypes_to_core(v), [f"S{i}" for i in range(6)])
    sinks.tsv(wide, path, ["CHR", "POS"], ["CHR", "POS", "REF", *[f"S{i}_snippy" for i in range(6)]])
    datasource.register(v.spark)
    rows = v.spark.read.format("core_alleles").option("bytes", 1 << 16).load(path)
    return rows.where("pos >= 100 AND pos < 9000 AND allele != 'N'").drop("i")


@query("depth_source_gaps", lines.ORACLES["depth_text_gaps"])
def depth_source_gaps(v):
    """Runs under a depth of 2 of depth text read as a format of spark.read."""
    path = in_order(v, v.table("orders").selectExpr("o_orderkey AS p", "concat_ws('\t', 'c1', o_orderkey, o_custkey % 4) AS value"), "depth.txt")
    datasource.register(v.spark)
    return iv.depth_gaps(v.spark.read.format("depth_text").option("bytes", 1 << 16).load(path).select("pos", "depth"), [], 2)


# Reports


def comparison(v: Views) -> Comparison:
    about = v.spark.createDataFrame([("gt", "Truth", True), ("p1", None, False), ("p2", None, False)], "pipeline string, label string, reference boolean")
    gaps = v.gap()  # given as they come, overlaps and all
    return Comparison(core.line_calls(v), gaps, v.ref_base(), v.samples(), v.ref_len, "gt", about=about, warnings=v.spark.createDataFrame([("w",)], "text string"))


def loaded(v: Views) -> report.Loaded:
    path = shared_path(v.spark, "report.json")
    comparison(v).write(path)
    return report.written(v.spark, path)


@query("report_reload", core.ORACLES["last_call_classification"])
def report_reload(v):
    """A report is written with its calls, gaps and reference, read, and its statistics computed anew."""
    x = loaded(v)
    again = Comparison(x.calls, x.gaps, x.ref_base, x.samples, x.ref_len, x.truth_id, about=x.pipelines)
    return again.global_stats()


@query("report_relations", " SELECT (SELECT count(*) FROM line) AS calls, (SELECT count(*) FROM gap) AS gaps, (SELECT n FROM n) AS bases, 6 AS samples, 'gt,p1,p2' AS pipelines, 'gt' AS truth, 1 AS warnings", core.LINES, plain=False)
def report_relations(v):
    """What a reloaded report holds."""
    x = loaded(v)
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    names = x.pipelines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pipeline"))), lambda p: p["pipeline"]), ",").alias("pipelines"))
    out = n(x.calls, "calls").crossJoin(n(x.gaps, "gaps")).crossJoin(n(x.ref_base, "bases")).crossJoin(n(x.samples, "samples")).crossJoin(names)
    return out.withColumn("truth", F.lit(x.truth_id)).crossJoin(n(x.warnings, "warnings"))


@query("binary_report", " SELECT * FROM ps", core.PAIRS, plain=False)
def binary_report(v):
    """The report in binary form, written and taken apart again."""
    path = shared_path(v.spark, "report.parquet")
    c = Comparison(v.call(), v.gap(), v.ref_base(), v.samples(), v.ref_len, "gt")
    sinks.report_binary(c.report(), path)
    return v.spark.read.parquet(path).select(F.inline("pairs"))


# BED sets

UNIQUE = """uq AS (SELECT g.sample, g.pos, g.pos - row_number() OVER (PARTITION BY g.sample ORDER BY g.pos) AS i FROM (SELECT * FROM gp WHERE pipeline = 'gt') g JOIN (SELECT * FROM gk WHERE pipeline = 'gt' AND k = 1) k USING (pos)),
ur AS (SELECT sample, min(pos) AS s, max(pos) + 1 AS e FROM uq GROUP BY sample, i),
mi AS (SELECT sample, pos, pos - row_number() OVER (PARTITION BY sample ORDER BY pos) AS i FROM gp WHERE pipeline = 'gt'), mr AS (SELECT sample, min(pos) AS s, max(pos) + 1 AS e FROM mi GROUP BY sample, i),
si AS (SELECT sample, pos, pos - row_number() OVER (PARTITION BY sample ORDER BY pos) AS i FROM gp WHERE pipeline = 'p1'), sr AS (SELECT sample, min(pos) AS s, max(pos) + 1 AS e FROM si GROUP BY sample, i),
oa AS (SELECT sample, pos, alt FROM call a WHERE pipeline = 'p1' AND qual > 100 AND dp > 10 AND NOT EXISTS (SELECT 1 FROM call b WHERE b.pipeline = 'p2' AND b.sample = a.sample AND b.pos = a.pos) ORDER BY qual DESC, sample, pos LIMIT 50)"""


@query("unique_gap_regions", ' SELECT sample, s AS start, e AS "end" FROM ur', UNIQUE, plain=False)
def unique_gap_regions(v):
    """The regions in which a sample is gapped alone, in the truth's gaps."""
    return qc.unique_regions(core.merged(v).where("pipeline = 'gt'").drop("pipeline"))


@query(
    "bed_sets",
    """ SELECT 'ALL_UNIQUE_GAPS' AS name, 'track name="ALL_UNIQUE_GAPS" description="All unique gaps (' || count(*) || ' regions, ' || coalesce(sum(e - s), 0) || ' bp total)" color=255,0,0' AS value FROM ur HAVING count(*) > 0
    UNION ALL SELECT 'ALL_UNIQUE_GAPS', 'c1' || chr(9) || s || chr(9) || e || chr(9) || sample FROM ur
    UNION ALL SELECT sample || '_mm2_gaps', 'track name="' || sample || '_mm2_gaps" description="' || sample || ' - mm2 gaps (' || count(*) || ' regions, ' || sum(e - s) || ' bp)" color=233,69,96' FROM mr GROUP BY sample
    UNION ALL SELECT sample || '_mm2_gaps', 'c1' || chr(9) || s || chr(9) || e || chr(9) || 'mm2_gap' FROM mr
    UNION ALL SELECT sample || '_snippy_gaps', 'track name="' || sample || '_snippy_gaps" description="' || sample || ' - Snippy gaps (' || count(*) || ' regions, ' || sum(e - s) || ' bp)" color=59,130,246' FROM sr GROUP BY sample
    UNION ALL SELECT sample || '_snippy_gaps', 'c1' || chr(9) || s || chr(9) || e || chr(9) || 'snippy_gap' FROM sr
    UNION ALL SELECT 'SNP_Snippy_only', 'track name="SNP_Snippy_only" description="Snippy-only SNPs (' || count(*) || ' positions)" color=59,130,246' FROM oa HAVING count(*) > 0
    UNION ALL SELECT 'SNP_Snippy_only', 'c1' || chr(9) || greatest(pos - 1, 0) || chr(9) || pos || chr(9) || sample || ':?>' || alt FROM oa""",
    UNIQUE,
    plain=False,
)
def bed_sets(v):
    """All BED files are written in one pass and read back with their names."""
    gaps = core.merged(v)
    of = lambda p: gaps.where(F.col("pipeline") == p).drop("pipeline")
    call = v.call().select("pipeline", "sample", F.lit("c").alias("chrom"), "pos", "alt", "qual", F.col("dp").alias("depth"), F.lit(None).cast("double").alias("af"))
    pos = callsets.positions(call.where("pipeline = 'p1'"), call.where("pipeline = 'p2'"), None, "p1", "p2")
    only = callsets.top_missed(pos, "a").select("sample", "pos", F.lit(None).cast("string").alias("ref"), F.col("a_alt").alias("alt"))
    rows = sinks.bed_sets("c1 and more", qc.unique_regions(of("gt")), {"mm2": of("gt"), "snippy": of("p1")}, only={"snippy": only})
    path = shared_path(v.spark, "beds")
    sinks.write_bed_sets(rows, path)
    return v.spark.read.text(path).select("name", "value")


# Pileups

_PILE = "CASE o_orderkey % 6 WHEN 0 THEN '.,' WHEN 1 THEN '^A.aG$a' WHEN 2 THEN ',+2ACGT' WHEN 3 THEN '*-1Cg' WHEN 4 THEN 'aCg^.TT' ELSE '^+.-12acgtacgtacgtNg,,' END"


@query("mpileup_consensus", "SELECT o_orderkey AS pos, CASE o_orderkey % 6 WHEN 1 THEN 'A' WHEN 4 THEN 'T' WHEN 5 THEN 'C' END AS base FROM orders")
def mpileup_consensus(v):
    """The most common base of three reads or more, ties to the first letter, decoded without a Python worker."""
    rows = v.table("orders").selectExpr("'s' AS sample", "'c' AS chrom", "o_orderkey AS pos", "'c' AS ref", f"{_PILE} AS bases")
    return alignments.mpileup_consensus(rows).select("pos", "base")


_SEQ = "substr('ACGTNACGTTGCAACGTACGTTGCANGTCA', CAST(1 + l_partkey % 6 AS INT), 24)"
_BASES = f"""WITH r AS (SELECT l_orderkey AS pos, 3 + l_partkey % 5 AS m1, 1 + l_suppkey % 3 AS gap, l_linenumber % 3 AS kind, 2 + l_linenumber AS m2, {_SEQ} AS q FROM lineitem),
b AS (SELECT pos - 1 AS r, 2 AS o, m1 AS len, q FROM r UNION ALL SELECT pos - 1 + m1 + CASE WHEN kind = 0 THEN 0 ELSE gap END, 2 + m1 + CASE WHEN kind = 0 THEN gap ELSE 0 END, m2, q FROM r),
e AS (SELECT r + i AS pos, substr(q, CAST(o + i + 1 AS INT), 1) AS base FROM (SELECT *, unnest(range(len)) AS i FROM b)),
c AS (SELECT pos, base, count(*) AS n FROM e WHERE base <> 'N' GROUP BY ALL),
g AS (SELECT pos, sum(n) AS depth, max(n) AS best, arg_max(base, n * 100 + ascii(base)) AS base FROM c GROUP BY pos),
k AS (SELECT pos, CASE WHEN depth < 4 THEN '-' WHEN best / CAST(depth AS DOUBLE) < 0.3 THEN 'N' ELSE base END AS call, CAST(depth AS BIGINT) AS depth, CASE WHEN depth < 4 THEN 0.0 ELSE best / CAST(depth AS DOUBLE) END AS consensus FROM g),
f AS (SELECT o_orderkey AS pos, {_BASE} AS base FROM orders)"""


def counts(v: Views, positions: DataFrame | None = None) -> DataFrame:
    cigar = "concat('2S', 3 + l_partkey % 5, 'M', 1 + l_suppkey % 3, CASE l_linenumber % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'D' ELSE 'N' END, 2 + l_linenumber, 'M3H')"
    reads = v.table("lineitem").selectExpr("0 AS flag", "l_orderkey AS pos", f"{cigar} AS cigar", f"{_SEQ} AS seq")
    return alignments.base_counts(reads, positions=positions)


@query("pileup_base_calls", f"{_BASES} SELECT * FROM k")
def pileup_base_calls(v):
    """Every position's base, depth and consensus from aligned reads."""
    return alignments.base_calls(counts(v), 4, 0.3)


@query("pileup_at_positions", f"{_BASES} SELECT * FROM k WHERE pos IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def pileup_at_positions(v):
    return alignments.base_calls(counts(v, v.table("orders").where("o_custkey % 10 = 0").selectExpr("o_orderkey AS pos")), 4, 0.3)


@query("pileup_snp_calls", f"{_BASES} SELECT k.pos + 1 AS pos, f.base AS ref, call AS alt, depth, consensus FROM k JOIN f USING (pos) WHERE call NOT IN ('-', 'N') AND call <> f.base")
def pileup_snp_calls(v):
    return alignments.pileup_snps(counts(v), v.table("orders").select(F.col("o_orderkey").alias("pos"), F.expr(_BASE).alias("base")), 4, 0.3)


@query("pileup_snp_count", f"{_BASES} SELECT count(*) FILTER (call NOT IN ('-', 'N') AND call <> f.base) AS snps, count(*) FILTER (call <> '-') AS covered FROM k JOIN f USING (pos)")
def pileup_snp_count(v):
    return alignments.pileup_counts(counts(v), v.table("orders").select(F.col("o_orderkey").alias("pos"), F.expr(_BASE).alias("base")), 4, 0.3)


@query(
    "alignment_metrics",
    """WITH o AS (SELECT 'c' || s_suppkey AS target, CAST(coalesce(sum(1000) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM supplier), n AS (SELECT CAST(count(*) * 1000 AS DOUBLE) AS n FROM supplier),
a AS (SELECT 'S' || (l_orderkey % 6) AS sample, o + l_partkey % 900 AS s, o + l_partkey % 900 + 1 + l_linenumber AS e, l_partkey % 400 AS m, l_partkey % 400 + l_linenumber AS b FROM lineitem JOIN o ON target = 'c' || l_suppkey),
p AS (SELECT sample, count(DISTINCT pos) AS c FROM (SELECT sample, unnest(range(s, e)) AS pos FROM a) GROUP BY sample)
SELECT sample, sum(m) / CAST(sum(b) AS DOUBLE) AS identity, least(sum(e - s) / any_value(n), 1.0) AS coverage, any_value(c) / any_value(n) AS merged_coverage FROM a JOIN p USING (sample), n GROUP BY sample""",
)
def alignment_metrics(v):
    """Identity and coverage of PAF alignments on concatenated contigs, overlaps counted twice and once."""
    line = lines.as_lines(v.table("lineitem"), "concat('S', l_orderkey % 6)", "500", "0", "400", "'+'", "concat('c', l_suppkey)", "1000", "l_partkey % 900", "l_partkey % 900 + 1 + l_linenumber", "l_partkey % 400", "l_partkey % 400 + l_linenumber", "60")
    paf = text.paf(v.spark, line).withColumnRenamed("query", "sample")
    s = v.table("supplier").selectExpr("'r' AS sample", "concat('c', s_suppkey) AS contig", "CAST(s_suppkey AS INT) AS contig_idx", "1000L AS length")
    return alignments.alignment_metrics(paf, iv.offsets(s), s.count() * 1000)


# Sorted tables

PAGED = """pg AS (SELECT *, coalesce(a_qual, b_qual) AS q FROM cg),
p1 AS (SELECT 'quality' AS sort, sample, chrom, pos, CAST(row_number() OVER (ORDER BY q DESC, sample, chrom, pos) - 1 AS BIGINT) AS place FROM pg),
p2 AS (SELECT 'position' AS sort, sample, chrom, pos, CAST(row_number() OVER (ORDER BY pos DESC, status, sample, chrom) - 1 AS BIGINT) AS place FROM pg)"""
QUALITY = [("q", False), ("sample", True), ("chrom", True), ("pos", True)]
POSITION = [("pos", False), ("status", True), ("sample", True), ("chrom", True)]


def table(v: Views) -> DataFrame:
    """The positions with the quality they are sorted by, written once for all orders and pages."""
    return v.once("positions", lambda: core.callset_positions(v).withColumn("q", F.coalesce("a_qual", "b_qual")))


@query("sorted_pages", " SELECT * FROM p1 WHERE place // 40 = 2 UNION ALL SELECT * FROM p2 WHERE place // 40 = 2", core.CALLSET, PAGED, plain=False)
def sorted_pages(v):
    """Page 2 of a table by two orders: by quality from the best, and by position from the last."""
    page = lambda name, order: callsets.pages(table(v), order, 40).where("page = 2").select(F.lit(name).alias("sort"), "sample", "chrom", "pos", "place")
    return page("quality", QUALITY).unionByName(page("position", POSITION))


@query("next_page", " SELECT sample, chrom, pos FROM p1 WHERE place // 40 = 1 UNION ALL SELECT sample, chrom, pos FROM p2 WHERE place // 40 = 1", core.CALLSET, PAGED, plain=False)
def next_page(v):
    """The page behind the last row of the first one, by the same orders, found by keys instead of a count."""
    out = None
    for order in (QUALITY, POSITION):
        last = callsets.after(table(v), order, 40).collect()[-1]
        rows = callsets.after(table(v), order, 40, last.asDict()).select("sample", "chrom", "pos")
        out = rows if out is None else out.unionByName(rows)
    return out


GENES = """g1 AS (SELECT 'gene' AS sort, sample, name, CAST(row_number() OVER (ORDER BY lower(name), sample, name) - 1 AS BIGINT) AS place FROM af),
g2 AS (SELECT 'overlap' AS sort, sample, name, CAST(row_number() OVER (ORDER BY overlap_pct DESC, sample, name) - 1 AS BIGINT) AS place FROM af)"""


@query("gene_table_pages", " SELECT * FROM g1 WHERE place // 25 = 1 UNION ALL SELECT * FROM g2 WHERE place // 25 = 1", core.FEAT, GENES, plain=False)
def gene_table_pages(v):
    """The second page of the table of genes by name, and by overlap from the largest."""
    hit = core.affected_features(v)
    page = lambda by, up: features.table_pages(hit, by, up, 25).where("page = 1").select(F.lit(by).alias("sort"), "sample", "name", "place")
    return page("gene", True).unionByName(page("overlap", False))


# Shown values


@query(
    "shown_alleles",
    """ SELECT sample, pos, CASE WHEN in_gap THEN '-' WHEN a_alt = b_alt THEN a_alt WHEN a_alt IS NOT NULL AND b_alt IS NOT NULL THEN base ELSE coalesce(a_alt, b_alt, base) END AS allele FROM cg JOIN ref_base USING (pos)""",
    core.CALLSET,
    plain=False,
)
def shown_alleles(v):
    j = core.callset_positions(v).join(v.ref_base(), "pos")
    return j.select("sample", "pos", viewer.display_allele(F.col("in_gap"), F.col("a_alt"), F.col("b_alt"), F.col("base")).alias("allele"))


@query("corrected_concordance", " SELECT sample, CASE WHEN concordant + only_a + only_b > 0 THEN concordant / CAST(concordant + only_a + only_b AS DOUBLE) * 100 ELSE 0.0 END AS rate FROM cps", core.CALLSET, plain=False)
def corrected_concordance(v):
    per = callsets.per_sample(core.callset_positions(v))
    return per.select("sample", viewer.corrected_concordance(F.col("concordant"), F.col("only_a"), F.col("only_b")).alias("rate"))


PARTS = """us AS (SELECT sample, CAST(count(*) FILTER (k = 1) AS BIGINT) AS u, CAST(count(*) FILTER (k > 1) AS BIGINT) AS s FROM gp JOIN gk USING (pipeline, pos) WHERE pipeline = 'gt' GROUP BY sample)"""


@query("track_summary", " SELECT sample, (n.n - u - s) / CAST(n.n AS DOUBLE) * 100 AS covered_pct, u / CAST(u + s AS DOUBLE) * 100 AS unique_pct, s / CAST(u + s AS DOUBLE) * 100 AS shared_pct FROM us, n", PARTS, plain=False)
def track_summary(v):
    return viewer.track_summary(qc.unique_shared(core.merged(v).where("pipeline = 'gt'").drop("pipeline"), []), v.ref_len)


@query(
    "risk_texts",
    """, r AS (SELECT sample, u, u / CAST(n.n AS DOUBLE) * 100 AS p, (ascii(substr(sample, 2)) - 48) / 5.0 AS q FROM us, n)
    SELECT sample, CASE WHEN p > 5 THEN printf('EXCLUDE: Would reduce core by %.1f%% (%d unique gap bases). Severely damages SNP resolution.', p, u) WHEN p > 2 THEN printf('REVIEW: Would reduce core by %.1f%% (%d unique gap bases). Consider excluding.', p, u)
      WHEN p > 0.5 OR q < 0.3 THEN printf('CAUTION: Core reduction %.2f%% (%d unique gaps). Gap quality: %.2f', p, u, q::DOUBLE) ELSE printf('OK: Minimal impact (%.3f%%, %d unique gaps). Gap quality: %.2f', p, u, q::DOUBLE) END AS recommendation FROM r""",
    PARTS,
    plain=False,
)
def risk_texts(v):
    """The recommendation of each sample; the quality of gaps is a given number here."""
    gaps = core.merged(v).where("pipeline = 'gt'").drop("pipeline")
    quality = v.samples().select("sample", ((F.ascii(F.substring("sample", 2, 1)) - 48) / 5.0).alias("avg_quality"))
    impact = qc.impact(gaps, v.samples(), quality, v.ref_len).join(quality, "sample")
    return impact.select("sample", viewer.risk_text(impact).alias("recommendation"))


@query(
    "interpretations",
    """SELECT o_orderkey AS k, CASE WHEN p > 99 THEN 'Excellent: gaps do not affect variant calling' WHEN p > 95 THEN 'Good: most SNPs are preserved outside gap regions' WHEN p > 90 THEN 'Moderate: some SNPs fall in gaps - review thresholds'
      ELSE 'Warning: significant SNP loss in gaps - consider adjusting parameters' END AS retention,
    CASE WHEN c > 80 THEN 'High concordance' WHEN c > 50 THEN 'Moderate concordance: some differences in filtering approach' WHEN o_custkey > 500 THEN 'Low concordance: gaps flag more regions' ELSE 'Low concordance: the pipeline applies additional quality filters' END AS concordance
    FROM (SELECT *, 88 + o_custkey % 13 AS p, o_custkey % 101 AS c FROM orders)""",
)
def interpretations(v):
    t = v.table("orders")
    return t.select(F.col("o_orderkey").alias("k"), viewer.retention_text(88 + F.col("o_custkey") % 13).alias("retention"), viewer.concordance_text(F.col("o_custkey") % 101, F.col("o_custkey"), F.lit(500)).alias("concordance"))


@query("caller_folders", "SELECT 'n' || n_nationkey AS sample, CASE n_nationkey % 3 WHEN 0 THEN 'n' || n_nationkey || '_snippy_Xref' WHEN 1 THEN 'n' || n_nationkey || '_snippy' ELSE 'n' || n_nationkey END AS folder, CAST(1 + n_nationkey % 4 AS BIGINT) AS masked FROM nation")
def caller_folders(v):
    """Aligned sequences in the result folders of callers: of each sample the first folder by priority, and its masked bases."""
    s = v.table("nation").selectExpr("concat('n', n_nationkey) AS sample", "n_nationkey AS k")
    folders = F.array(F.when(F.col("k") % 3 == 0, F.concat("sample", F.lit("_snippy_Xref"))), F.when(F.col("k") % 3 < 2, F.concat("sample", F.lit("_snippy"))), F.col("sample"))
    files = s.select("k", F.posexplode(folders).alias("i", "folder")).where("folder IS NOT NULL")
    # The best folder of a sample masks 1 + k % 4 bases, the others ten more.
    best = F.col("i") == F.col("k") % 3
    files = files.withColumn("value", F.concat(F.lit(">x\nAC"), F.expr("repeat('N', CAST(1 + k % 4 AS INT))"), F.when(best, "").otherwise("N" * 10)))
    root = shared_path(v.spark, "callers")
    jvm, conf = v.spark.sparkContext._jvm, v.spark.sparkContext._jsc.hadoopConfiguration()
    for r in files.select("folder", "value").collect():  # two or three small files for each of 25 nations
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.folder}/snps.aligned.fa")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(r.value.encode()))
        out.close()
    found = fasta.aligned_files(v.spark, root, s.select("sample"), "X")
    size = fasta.aligned_gaps(v.spark, found).groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("masked"))
    return found.select("sample", F.element_at(F.split("path", "/"), -2).alias("folder")).join(size, "sample")
