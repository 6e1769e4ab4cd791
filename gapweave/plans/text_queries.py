"""Queries of the text readers, parsers and writers.

The lines of each format are built from the star-schema tables, read by the readers and compared with SQL that
knows the fields they were built from, so the SQL never parses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions import variants as va
from gapweave.operators import alignments, features
from gapweave.plans.views import Views
from gapweave.sources import sinks, text
from gapweave.sources.store import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def scratch(v: Views, name: str) -> str:
    return shared_path(v.spark, name)


def as_lines(rows: DataFrame, *cells: str, file: str = "'x/a.vcf'", order: str = "1L", at: str | None = None) -> DataFrame:
    """Lines as the readers take them: (file, n, line), and ``at`` to order those of one number."""
    parts = ", ".join(f"CAST({c} AS STRING)" for c in cells)
    return rows.selectExpr(f"{file} AS file", f"{order} AS n", f"concat_ws('\t', {parts}) AS line", *([] if at is None else [f"{at} AS at"]))


# Variant calls.  ref has 1 to 3 letters, alt one more for every seventh order; the INFO and FORMAT columns vary.

_REF = "substr('ACGTACGT', CAST(1 + l_partkey % 4 AS INT), CAST(1 + l_linenumber % 3 AS INT))"
_ALT = "substr('GGTACCATG', CAST(1 + l_suppkey % 4 AS INT), CAST(1 + l_linenumber % 3 + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INT))"
_QUAL = "CASE WHEN l_orderkey % 5 = 0 THEN '.' ELSE CAST(l_partkey % 90 AS {string}) END"


def vcf_lines(v: Views) -> DataFrame:
    info = "CASE l_linenumber % 3 WHEN 0 THEN concat('AC=1;DP=', l_suppkey % 50, ';AF=0.25') WHEN 1 THEN concat('ADP=', l_suppkey % 50) ELSE 'NS=2' END"
    call = "concat('0/1:', l_partkey % 40, ':', l_suppkey % 9, ',', l_partkey % 9)"
    return as_lines(v.table("lineitem"), "'c1'", "l_orderkey", "'.'", _REF, _ALT, _QUAL.format(string="STRING"), "'PASS'", info, "'GT:DP:AD'", call, order="l_orderkey * 8 + l_linenumber", at="struct(_metadata.file_name, _metadata.row_index)")


_VCF = f"""WITH t AS (
  SELECT l_orderkey AS p, {_REF} AS r, {_ALT} AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS DOUBLE) END AS q, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk FROM lineitem
)"""


@query(
    "vcf_compare_calls",
    _VCF
    + """, k AS (SELECT p, r, a, coalesce(q, 0.0) AS qual, CASE WHEN ln % 3 = 2 THEN pk % 40 ELSE sk % 50 END AS dp FROM t WHERE p >= 1 AND (q IS NULL OR q >= 20) AND length(r) = length(a)),
x AS (SELECT *, unnest(range(1, length(r) + 1)) AS i FROM k)
SELECT p - 1 + i - 1 AS pos, substr(r, i, 1) AS ref, substr(a, i, 1) AS alt, qual, CAST(dp AS BIGINT) AS dp, length(r) > 1 AS mnp FROM x WHERE length(r) = 1 OR substr(r, i, 1) <> substr(a, i, 1)""",
)
def vcf_compare_calls(v):
    """Quality and indel filters, MNPs taken apart, depth from INFO before FORMAT."""
    return text.vcf_calls(v.spark, vcf_lines(v), 20.0).select("pos", "ref", "alt", "qual", "dp", "mnp")


@query(
    "vcf_compare_indels",
    _VCF + " SELECT count(*) AS n, CAST(sum(length(a)) AS BIGINT) AS letters, CAST(sum(p) AS BIGINT) AS places FROM t WHERE p >= 1 AND length(r) <> length(a)",
)
def vcf_compare_indels(v):
    c = text.vcf_calls(v.spark, vcf_lines(v), 0.0, include_indels=True).where(F.length("ref") != F.length("alt"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("alt")).alias("letters"), F.sum(F.col("pos") + 1).alias("places"))


@query(
    "vcf_quality_variants",
    _VCF
    + """, x AS (SELECT *, length(r) = length(a) AND length(r) > 1 AS mnp, unnest(range(1, CASE WHEN length(r) = length(a) THEN length(r) + 1 ELSE 2 END)) AS i FROM t),
y AS (SELECT p + i - 1 AS pos, CASE WHEN mnp THEN substr(r, i, 1) ELSE r END AS ref, CASE WHEN mnp THEN substr(a, i, 1) ELSE a END AS alt, coalesce(q, 0.0) AS qual, pk % 40 AS depth, p * 8 + ln AS n, mnp,
  CASE WHEN sk % 9 + pk % 9 > 0 THEN (pk % 9) / CAST(sk % 9 + pk % 9 AS DOUBLE) WHEN ln % 3 = 0 THEN 0.25 END AS af FROM x)
SELECT pos, ref, alt, qual, CAST(depth AS BIGINT) AS depth, af FROM y WHERE NOT mnp OR ref <> alt QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC) = 1""",
)
def vcf_quality_variants(v):
    """Of each place the last line; allele frequency from AD before INFO, depth from FORMAT before INFO."""
    return text.vcf_variants(v.spark, vcf_lines(v)).select("pos", "ref", "alt", "qual", "depth", "af")


@query(
    "variant_predicates",
    _VCF
    + """ SELECT count(*) FILTER (length(r) = 1 AND length(a) = 1) AS snps, count(*) FILTER (length(r) = length(a) AND length(r) > 1) AS mnps, count(*) FILTER (length(r) <> length(a)) AS indels,
  count(*) FILTER (pk % 4 <> 3) AS passed FROM t""",
)
def variant_predicates(v):
    t = v.table("lineitem").selectExpr(f"{_REF} AS ref", f"{_ALT} AS alt", "CASE l_partkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN '.' WHEN 2 THEN '' ELSE 'q10' END AS flt")
    return t.agg(F.count_if(va.is_snp("ref", "alt")).alias("snps"), F.count_if(va.is_mnp("ref", "alt")).alias("mnps"), F.count_if(va.is_indel("ref", "alt")).alias("indels"), F.count_if(va.is_pass("flt")).alias("passed"))


@query(
    "mnp_statistics",
    _VCF + " SELECT count(*) FILTER (length(r) = length(a) AND length(r) > 1) AS mnps, count(*) FILTER (length(r) = 1 AND length(a) = 1) AS snps, CAST(coalesce(sum(length(r)) FILTER (length(r) = length(a) AND length(r) > 1), 0) AS BIGINT) AS mnp_bases FROM t WHERE q IS NULL OR q >= 20",
)
def mnp_statistics(v):
    """How many calls are MNPs, and how many bases they stand for."""
    rows = text.vcf_rows(v.spark, vcf_lines(v)).where(va.quality_passes("qual_text", 20.0))
    return rows.agg(
        F.count_if(va.is_mnp("ref", "alt")).alias("mnps"),
        F.count_if(va.is_snp("ref", "alt")).alias("snps"),
        F.coalesce(F.sum(F.when(va.is_mnp("ref", "alt"), F.length("ref"))), F.lit(0)).cast("long").alias("mnp_bases"),
    )


@query(
    "genotype_alleles",
    "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'T' WHEN 3 THEN 'N' ELSE 'N' END AS allele FROM lineitem",
)
def genotype_alleles(v):
    t = v.table("lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "CASE l_partkey % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '1/2' WHEN 2 THEN '2|2' WHEN 3 THEN './.' ELSE '3/1' END AS gt", "'A' AS ref", "'C,T' AS alt")
    return t.select("k", "n", va.genotype_allele("gt", "ref", "alt").alias("allele"))


@query(
    "vcf_sample_names",
    "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'dir' || n_nationkey ELSE 's' || n_nationkey END AS sample FROM nation",
)
def vcf_sample_names(v):
    file = F.expr("CASE n_nationkey % 4 WHEN 0 THEN concat('/x/dir', n_nationkey, '/var.flt.vcf') WHEN 1 THEN concat('/x/s', n_nationkey, '.filt.vcf') WHEN 2 THEN concat('/x/s', n_nationkey, '.subs.vcf.gz') ELSE concat('s', n_nationkey, '.vcf') END")
    return v.table("nation").select(F.col("n_nationkey").alias("k"), text.sample_name(file).alias("sample"))


# Alignments


_READS = "SELECT l_orderkey AS pos, 3 + l_partkey % 5 AS m1, 1 + l_suppkey % 3 AS gap, l_linenumber % 3 AS kind, 2 + l_linenumber AS m2, l_orderkey % 11 = 0 AS unmapped FROM lineitem"


def reads(v: Views) -> DataFrame:
    """Reads with a match, an insertion, a deletion or a skip, and a match, between clips."""
    cigar = "concat('2S', 3 + l_partkey % 5, 'M', 1 + l_suppkey % 3, CASE l_linenumber % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'D' ELSE 'N' END, 2 + l_linenumber, 'M3H')"
    flag = "CASE WHEN l_orderkey % 11 = 0 THEN 4 ELSE 0 END"
    line = as_lines(v.table("lineitem"), "concat('r', l_orderkey)", flag, "'c1'", "l_orderkey", "60", cigar, "'*'", "0", "0", "repeat('ACGT', 6)", "'*'")
    return text.sam(v.spark, line)


@query(
    "sam_depth",
    f"""WITH r AS ({_READS}), n AS (SELECT count(*) AS n FROM orders), p AS (
  SELECT unnest(range(pos - 1, least(pos - 1 + m1 + m2 + CASE WHEN kind = 0 THEN 0 ELSE gap END, n))) AS p FROM r, n WHERE NOT unmapped
), d AS (SELECT p, count(*) AS k FROM p GROUP BY p) SELECT k, count(*) AS positions FROM d GROUP BY k""",
)
def sam_depth(v):
    """Positions by depth of SAM text; a read covers its whole span."""
    c = alignments.coverage(reads(v), v.ref_len)
    return c.groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


@query(
    "read_depth_metrics",
    f"""WITH r AS ({_READS}), n AS (SELECT count(*) AS n FROM orders), p AS (
  SELECT unnest(range(pos - 1, least(pos - 1 + m1 + m2 + CASE WHEN kind = 0 THEN 0 ELSE gap END, n))) AS p FROM r, n WHERE NOT unmapped
), d AS (SELECT p, count(*) AS k FROM p GROUP BY p)
SELECT CAST(sum(k) AS DOUBLE) / any_value(n) AS mean_depth, CAST(count(*) AS DOUBLE) / any_value(n) AS covered, CAST(count(*) FILTER (k >= 10) AS DOUBLE) / any_value(n) AS covered_10, CAST(max(k) AS BIGINT) AS max_depth FROM d, n""",
)
def read_depth_metrics(v):
    """One row of coverage metrics of reads: mean depth and the shares of the reference under any and under ten reads."""
    n = v.ref_len
    bases = F.col("end") - F.col("start")
    at_least = lambda k: F.coalesce(F.sum(F.when(F.col("k") >= k, bases)), F.lit(0)).cast("double") / n
    return alignments.coverage(reads(v), n).agg((F.sum(F.col("k") * bases).cast("double") / n).alias("mean_depth"), at_least(1).alias("covered"), at_least(10).alias("covered_10"), F.max("k").cast("long").alias("max_depth"))


@query(
    "cigar_blocks",
    f"""WITH r AS ({_READS}), b AS (
  SELECT pos - 1 AS r, 2 AS q, m1 AS len FROM r UNION ALL SELECT pos - 1 + m1 + CASE WHEN kind = 0 THEN 0 ELSE gap END, 2 + m1 + CASE WHEN kind = 0 THEN gap ELSE 0 END, m2 FROM r
) SELECT r, CAST(q AS BIGINT) AS q, CAST(len AS BIGINT) AS len, count(*) AS n FROM b GROUP BY ALL""",
)
def cigar_blocks(v):
    return alignments.blocks(reads(v)).groupBy("r", "q", "len").agg(F.count(F.lit(1)).alias("n"))


@query(
    "paf_alignments",
    """SELECT 'S' || (l_suppkey % 6) AS query, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey % 400) AS BIGINT) AS matches, CAST(sum(l_partkey % 400 + l_suppkey % 9) AS BIGINT) AS block,
  CAST(sum(l_partkey % 400) AS DOUBLE) / sum(l_partkey % 400 + l_suppkey % 9) AS identity FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY 1""",
)
def paf_alignments(v):
    """Alignment averages by query; a line with a field that is no number is left out."""
    line = as_lines(v.table("lineitem"), "concat('S', l_suppkey % 6)", "500", "0", "l_partkey % 400", "'+'", "'c1'", "9000", "l_orderkey", "l_orderkey + 5", "CASE WHEN l_orderkey % 13 = 0 THEN 'x' ELSE CAST(l_partkey % 400 AS STRING) END", "l_partkey % 400 + l_suppkey % 9", "60")
    g = text.paf(v.spark, line).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("matches").alias("matches"), F.sum("block").alias("block"))
    return g.withColumn("identity", F.col("matches").cast("double") / F.col("block"))


@query(
    "pileup_bases",
    """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'CC' WHEN 1 THEN 'CAG' WHEN 2 THEN 'CT' WHEN 3 THEN '' ELSE 'ACGT' END AS bases FROM orders""",
)
def pileup_bases(v):
    """mpileup base strings: reference marks, read starts with a quality, ends, deletions and insertions."""
    raw = "CASE o_orderkey % 5 WHEN 0 THEN '.,' WHEN 1 THEN '^A.aG$' WHEN 2 THEN ',+2ACGT' WHEN 3 THEN '*-1Cg' ELSE 'aCg^.T' END"
    return v.table("orders").select(F.col("o_orderkey").alias("k"), alignments.decoded(F.expr(raw), F.lit("c")).alias("bases"))


# Positions and tables


@query(
    "depth_text_gaps",
    """WITH o AS (SELECT o_orderkey AS p FROM orders WHERE o_custkey % 4 < 2), i AS (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM o)
SELECT min(p) AS start, max(p) + 1 AS "end" FROM i GROUP BY g""",
)
def depth_text_gaps(v):
    """Runs under a depth of 2 from ``contig pos depth`` text."""
    return text.depth_gaps(v.spark, as_lines(v.table("orders"), "'c1'", "o_orderkey", "o_custkey % 4"), 2)


@query(
    "zero_depth_text_gaps",
    """WITH o AS (SELECT 'S' || (o_orderkey // 1000 % 3) AS sample, o_orderkey AS p FROM orders WHERE o_custkey % 3 = 0), i AS (SELECT *, p - row_number() OVER (PARTITION BY sample ORDER BY p) AS g FROM o)
SELECT sample, min(p) AS start, max(p) + 1 AS "end" FROM i GROUP BY sample, g""",
)
def zero_depth_text_gaps(v):
    return text.zero_depth_gaps(v.spark, as_lines(v.table("orders"), "'c1'", "o_orderkey", "'A'", "o_custkey % 3", file="concat('/x/S', o_orderkey div 1000 % 3, '/p.txt')"))


@query(
    "gff_features",
    """SELECT p_partkey AS start, p_partkey + p_size AS "end", CASE WHEN p_partkey % 3 = 0 THEN 'g,' || p_partkey WHEN p_partkey % 3 = 1 THEN 'G' || p_partkey END AS gene,
  CASE WHEN p_partkey % 3 = 2 THEN 'L' || p_partkey END AS locus_tag, CASE WHEN p_partkey % 3 <> 1 THEN 'a%;b' END AS product,
  CASE WHEN p_partkey % 3 = 0 THEN 'g,' || p_partkey WHEN p_partkey % 3 = 1 THEN 'G' || p_partkey ELSE 'L' || p_partkey END AS shown FROM part""",
)
def gff_features(v):
    """Attributes of GFF3 with percent codes and of GTF with quotes."""
    attrs = "CASE p_partkey % 3 WHEN 0 THEN concat('ID=i;Name=g%2C', p_partkey, ';product=a%25%3Bb') WHEN 1 THEN concat('gene_id \"G', p_partkey, '\"; gene_name \"h', p_partkey, '\";') ELSE concat('locus_tag=L', p_partkey, ';product=a%25%3Bb') END"
    g = text.gff(v.spark, as_lines(v.table("part"), "'c1'", "'.'", "'CDS'", "p_partkey", "p_partkey + p_size", "'.'", "'+'", "'0'", attrs))
    return g.select("start", "end", "gene", "locus_tag", "product", F.coalesce("gene", "locus_tag").alias("shown"))


@query(
    "core_table_round_trip",
    """SELECT 'S' || u.i AS sample, o_orderkey AS pos, CASE WHEN o_custkey % 6 = u.i THEN 'T' ELSE substr('ACG', CAST(1 + o_orderkey % 3 AS INT), 1) END AS allele FROM orders, (SELECT unnest(range(6)) AS i) u""",
)
def core_table_round_trip(v):
    """A wide core table is written as text and read again."""
    o = v.table("orders").selectExpr("'c1' AS chrom", "o_orderkey AS pos", "substr('ACG', CAST(1 + o_orderkey % 3 AS INT), 1) AS ref", "concat('S', o_custkey % 6) AS sample", "'T' AS allele")
    path = scratch(v, "core.tsv")
    sinks.tsv(sinks.core_wide(o, [f"S{i}" for i in range(6)]), path, ["CHR", "POS"], ["CHR", "POS", "REF", "S0_snippy", "S1_snippy_snippy", "S2", "S3", "S4", "S5_snippy"])
    return text.core_snps(v.spark, path, "p").select("sample", "pos", "allele")


_SQUARE = "SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_nationkey - b.n_nationkey) * 3 AS d FROM nation a, nation b"


@query("matrix_round_trip", f"SELECT 'n' || i AS row, 'n' || j AS col, CAST(d AS BIGINT) AS distance FROM ({_SQUARE})")
def matrix_round_trip(v):
    """A distance matrix is written with an empty corner and read again."""
    n = v.table("nation").selectExpr("n_nationkey AS i")
    square = n.crossJoin(n.selectExpr("i AS j")).selectExpr("concat('n', i) AS row", "concat('n', j) AS col", "abs(i - j) * 3 AS distance")
    names = sorted(r.row for r in square.select("row").distinct().collect())
    path = scratch(v, "matrix.tsv")
    sinks.matrix(square, names, path)
    return text.distance_matrix(v.spark, path)


@query("matrix_corner", "SELECT CAST(1 AS BIGINT) AS heads, CAST((SELECT count(*) FROM nation) AS BIGINT) AS samples")
def matrix_corner(v):
    """The first cell of a matrix file is empty, without quotes."""
    n = v.table("nation").selectExpr("concat('n', n_nationkey) AS row", "'n1' AS col", "0 AS distance")
    path = scratch(v, "corner.tsv")
    sinks.matrix(n, ["n1", "n2"], path)
    t = v.spark.read.text(path)
    return t.agg(F.count_if(F.col("value") == "\tn1\tn2").alias("heads"), F.count_if(~F.startswith("value", F.lit("\t"))).alias("samples"))


@query("snp_list_rows", "SELECT 's' || x.i AS sample, o_orderkey - 1 AS pos FROM orders, (SELECT unnest(range(3)) AS i) x WHERE o_orderkey >= 1 AND x.i < 1 + o_custkey % 3")
def snp_list_rows(v):
    line = as_lines(v.table("orders"), "'c1'", "o_orderkey", "1 + o_custkey % 3", "concat_ws('\t', slice(array('s0', 's1', 's2'), 1, CAST(1 + o_custkey % 3 AS INT)))")
    return text.snp_list(v.spark, line).select("sample", "pos")


@query("core_statistics_rows", "SELECT 'c' || c_custkey AS sample, CAST(c_custkey AS BIGINT) AS length, CAST(c_custkey % 7 AS BIGINT) AS lowcov FROM customer")
def core_statistics_rows(v):
    line = as_lines(v.table("customer"), "concat('c', c_custkey, '_snippy')", "c_custkey", "1", "2", "3", "4", "5", "c_custkey % 7")
    head = v.spark.createDataFrame([("f", 0, "ID\tLENGTH\tALIGNED\tUNALIGNED\tVARIANT\tHET\tMASKED\tLOWCOV"), ("f", 1, "Reference\t1\t1\t1\t1\t1\t1\t1")], "file string, n long, line string")
    return text.core_stats(v.spark, head.unionByName(line)).select("sample", "length", "lowcov")


@query("snp_metrics_rows", "SELECT 'c' || c_custkey AS sample, (c_custkey % 100) / 2.0::DOUBLE AS percent_mapped, CAST(c_custkey % 90 AS DOUBLE) AS depth, CAST(c_custkey AS BIGINT) AS snps, CAST(3 AS BIGINT) AS missing FROM customer")
def snp_metrics_rows(v):
    cells = ["'x'"] * 16
    cells[0], cells[7], cells[10], cells[13], cells[15] = "concat('\"c', c_custkey, '\"')", "c_custkey % 100 / 2", "c_custkey % 90", "c_custkey", "3"
    return text.snp_metrics(v.spark, as_lines(v.table("customer"), *cells))


@query("bed_rows", "SELECT 'chr\t' || p_partkey || '\t' || (p_partkey + p_size) || '\t' || p_brand || '\t0\t.\t' || p_partkey || '\t' || (p_partkey + p_size) || '\t' || CASE WHEN p_size > 25 THEN '255,0,0' ELSE '0,255,0' END AS value FROM part")
def bed_rows(v):
    r = v.table("part").select(F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), "p_brand", F.when(F.col("p_size") > 25, sinks.RISK_RGB["Critical"]).otherwise(sinks.RISK_RGB["Low"]).alias("rgb"))
    return sinks.bed_lines(r, "chr", name="p_brand", color="rgb")


@query(
    "fasta_contigs",
    """SELECT 'c' || s_suppkey AS contig, CAST(4 * (1 + s_suppkey % 5) AS BIGINT) AS length, repeat('ACGN', CAST(1 + s_suppkey % 5 AS INT)) AS sequence FROM supplier""",
)
def fasta_contigs(v):
    """Records over several lines, in lower case, are read with upper case."""
    rec = v.table("supplier").selectExpr("concat('>c', s_suppkey, ' text\n', regexp_replace(repeat('acgn', CAST(1 + s_suppkey % 5 AS INT)), '(.{6})', '$1\n')) AS value")
    path = scratch(v, "s1.fasta")
    rec.write.text(path)
    return text.fasta(v.spark, path).select("contig", "length", "sequence")


@query(
    "masked_text_gaps",
    """WITH s AS (SELECT s_suppkey AS k, sum(4 * (1 + s_suppkey % 5)) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o, 1 + s_suppkey % 5 AS m FROM supplier)
SELECT CAST(coalesce(o, 0) + 4 * i + 4 AS BIGINT) AS start, CAST(coalesce(o, 0) + 4 * i + 5 AS BIGINT) AS "end" FROM (SELECT *, unnest(range(m)) AS i FROM s)""",
)
def masked_text_gaps(v):
    """Runs of N over the concatenated contigs."""
    c = v.table("supplier").selectExpr("'s' AS sample", "concat('c', s_suppkey) AS contig", "CAST(s_suppkey AS INT) AS contig_idx", "CAST(4 * (1 + s_suppkey % 5) AS BIGINT) AS length", "repeat('ACGN', CAST(1 + s_suppkey % 5 AS INT)) AS sequence")
    return text.masked_gaps(c).select("start", "end")
