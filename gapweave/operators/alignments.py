"""Coverage, pileups and alignment metrics from alignment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.functions import variants as va


def coverage(reads: DataFrame, ref_len: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, k): segments of depth k > 0 of mapped reads (flag, pos, cigar); a read covers its whole
    reference span, deletions included, cut to the reference."""
    keys = keys or []
    ok = reads.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("pos") >= 1) & (F.col("cigar") != "*"))
    span = ok.select(*keys, (F.col("pos") - 1).alias("start"), F.least(F.col("pos") - 1 + va.cigar_span("cigar"), F.lit(ref_len)).alias("end"))
    return iv.sweep(span, keys)


def low_coverage(reads: DataFrame, ref_len: int, min_depth: int) -> DataFrame:
    """(start, end): maximal runs with less than the minimum depth."""
    enough = coverage(reads, ref_len).where(F.col("k") >= min_depth)
    spark = reads.sparkSession
    return iv.complement(enough, [], spark.createDataFrame([(ref_len,)], "length long"))


#: Operations of a CIGAR that are walked in one go; a long one is walked in parts, so its cost stays in proportion.
OPS = 128

#: Letters of operations by what they take: M read and reference, D reference bases only, I read bases only, H none.
_KINDS = "'M=XDNISHP', 'MMMDDIIHH'"


def blocks(reads: DataFrame) -> DataFrame:
    """A row per aligned block of a read: its columns, r and q (0-based starts on reference and read) and len.  M, = and X
    align; I and S take read bases only, D and N reference bases only, H and P none.

    A CIGAR is taken apart once: its operations come from a generator, which the optimizer doesn't copy into what reads them."""
    op = lambda n, kind: f"named_struct('n', CAST({n} AS BIGINT), 'k', translate({kind}, {_KINDS}))"
    plain = f"zip_with(split(translate(left(cigar, length(cigar) - 1), 'MIDNSHP=X', '         '), ' '), split(translate(cigar, '0123456789', ''), ''), (n, o) -> {op('n', 'o')})"
    found = f"transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 0), x -> {op('substr(x, 1, length(x) - 1)', 'right(x, 1)')})"
    out = reads.withColumn("ops", F.explode(F.array(F.expr(f"IF(cigar RLIKE '^([0-9]+[MIDNSHP=X])+$', {plain}, {found})")))).where("size(ops) > 0")
    place = "CAST(array() AS array<struct<r:bigint,q:bigint,len:bigint>>)"
    step_r, step_q = "IF(x.k = 'M' OR x.k = 'D', x.n, 0L)", "IF(x.k = 'M' OR x.k = 'I', x.n, 0L)"
    walk = lambda ops, r, q: f"""aggregate({ops}, named_struct('r', {r}, 'q', {q}, 'out', {place}), (a, x) -> named_struct('r', a.r + {step_r}, 'q', a.q + {step_q},
          'out', IF(x.k = 'M', array_append(a.out, named_struct('r', a.r, 'q', a.q, 'len', x.n)), a.out)), a -> a.out)"""  # noqa: E731
    # Of a long one, where each part begins, then its blocks from there.
    parts = f"transform(sequence(0, (size(ops) - 1) div {OPS}), b -> slice(ops, CAST(b * {OPS} + 1 AS INT), {OPS}))"
    sums = f"transform({parts}, p -> named_struct('r', aggregate(p, 0L, (a, x) -> a + {step_r}), 'q', aggregate(p, 0L, (a, x) -> a + {step_q})))"
    starts = f"aggregate({sums}, named_struct('r', pos - 1, 'q', 0L, 'out', {place}), (a, s) -> named_struct('r', a.r + s.r, 'q', a.q + s.q, 'out', array_append(a.out, named_struct('r', a.r, 'q', a.q, 'len', 0L))), a -> a.out)"
    long = f"flatten(zip_with({parts}, {starts}, (p, s) -> {walk('p', 's.r', 's.q')}))"
    return out.select(*reads.columns, F.inline(F.expr(f"IF(size(ops) <= {OPS}, {walk('ops', 'pos - 1', '0L')}, {long})")))


#: Positions whose bases are counted together.
COUNT_BIN = 256


def base_counts(reads: DataFrame, keys: list[str] | None = None, positions: DataFrame | None = None) -> DataFrame:
    """(keys, bin, pos 0-based, base, n) of the read bases over the reference, N left out; every record counts.  With
    ``positions`` (pos) only those.

    Aligned blocks, cut to bins of positions, are shuffled, never single bases: a bin is counted where its blocks meet, and what
    groups the counts by bin and position needs no other shuffle."""
    keys = keys or []
    at = lambda pos: F.expr(f"({pos} - pmod({pos}, {COUNT_BIN})) div {COUNT_BIN}")
    b = blocks(reads).where("len > 0").select(*keys, "r", F.expr("upper(substr(seq, CAST(q + 1 AS INT), CAST(len AS INT)))").alias("s")).where("s != ''")
    b = b.select(*keys, "r", "s", F.explode(F.sequence(at("r"), at("(r + length(s) - 1)"))).alias("bin")).withColumn("from", F.greatest("r", F.col("bin") * COUNT_BIN))
    b = b.select(*keys, "bin", "from", F.expr(f"substr(s, CAST(from - r + 1 AS INT), CAST((bin + 1) * {COUNT_BIN} - from AS INT))").alias("s")).repartition(*keys, "bin")
    if positions is not None:
        asked = positions.groupBy(at("pos").alias("bin")).agg(F.collect_set("pos").alias("asked"))
        b = b.join(asked.hint("shuffle_hash"), "bin")
    each = b.select("*", F.posexplode(F.split("s", "")).alias("i", "base")).withColumn("pos", F.col("from") + F.col("i")).where("base NOT IN ('', 'N')")
    if positions is not None:
        each = each.where("array_contains(asked, pos)")
    return each.groupBy(*keys, "bin", "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def base_calls(counts: DataFrame, min_depth: int, min_consensus: float = 0.8, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, call, depth, consensus): the most frequent base (ties: the last by letter), - for too little depth
    (consensus 0), N without enough agreement."""
    keys = keys or []
    bins = [c for c in counts.columns if c == "bin"]
    g = counts.groupBy(*keys, *bins, "pos").agg(F.sum("n").alias("depth"), F.max("n").alias("best"), F.max_by("base", F.struct("n", "base")).alias("base"))
    call = va.base_call("depth", "best", "depth", "base", min_depth, min_consensus)
    return g.select(*keys, "pos", call.alias("call"), "depth", F.when(F.col("depth") < min_depth, 0.0).otherwise(F.col("best") / F.col("depth")).alias("consensus"))


def pileup_snps(counts: DataFrame, ref_base: DataFrame, min_depth: int, min_consensus: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, pos 1-based, ref, alt, depth, consensus) of calls that differ from the upper-cased reference base."""
    c = base_calls(counts, min_depth, min_consensus, keys).where("call NOT IN ('-', 'N')").join(ref_base, "pos")
    return c.where(F.upper("base") != F.col("call")).select(*(keys or []), (F.col("pos") + 1).alias("pos"), F.upper("base").alias("ref"), F.col("call").alias("alt"), "depth", "consensus")


def pileup_counts(counts: DataFrame, ref_base: DataFrame, min_depth: int, min_consensus: float) -> DataFrame:
    """(snps, covered): covered counts positions with enough depth, whatever they agree on."""
    c = base_calls(counts, min_depth, min_consensus).join(ref_base, "pos")
    return c.agg(F.count_if(~F.col("call").isin("-", "N") & (F.col("call") != F.upper("base"))).alias("snps"), F.count_if(F.col("call") != "-").alias("covered"))


def _walk_bases(bases: Column, ref: Column, start: Column, add) -> Column:
    """Folds ``add(out, base)`` over the read bases of an mpileup column.

    One pass over its characters: ``^`` takes the quality behind it along, an insertion or deletion the characters that its number
    names and one more, as the consensus this answers to does.  mode 1 is behind ``^``, 2 within a number."""
    number = lambda x: x.cast("int")
    state = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("mode"), F.lit(0).alias("n"), start.alias("out"))

    def step(a, c):
        upper = F.upper(c)
        base = F.when(c.isin(".", ","), F.upper(ref)).when(upper.isin("A", "C", "G", "T"), upper)
        digit = c.between("0", "9")
        mode = F.when((a["mode"] == 2) & digit, 2).when(a["mode"] != 0, 0).when(c == "^", 1).when(c.isin("+", "-"), 2).otherwise(0)
        read = F.when((a["skip"] > 0) | (a["mode"] != 0) | base.isNull(), a["out"]).otherwise(add(a["out"], base))
        skip = F.when(a["skip"] > 0, a["skip"] - 1).when((a["mode"] == 2) & ~digit, a["n"]).otherwise(0)
        n = F.when((a["mode"] == 2) & digit, a["n"] * 10 + F.when(digit, c).otherwise("0").try_cast("int")).otherwise(0)
        return F.struct(number(skip).alias("skip"), number(F.when(a["skip"] > 0, 0).otherwise(mode)).alias("mode"), number(F.when(a["skip"] > 0, 0).otherwise(n)).alias("n"), read.alias("out"))

    return F.aggregate(F.filter(F.split(bases, ""), lambda x: x != ""), state, step, lambda a: a["out"])


def decoded(bases: Column, ref: Column) -> Column:
    """The read bases of an mpileup column as text."""
    return _walk_bases(bases, ref, F.lit(""), lambda out, base: F.concat(out, base))


def read_base_counts(bases: Column, ref: Column) -> Column:
    """struct<A, C, G, T> of the read bases of an mpileup column, in time proportional to its depth."""
    zero = F.struct(*[F.lit(0).alias(b) for b in "ACGT"])
    return _walk_bases(bases, ref, zero, lambda out, base: F.struct(*[(out[b] + (base == b).cast("int")).alias(b) for b in "ACGT"]))


def mpileup_consensus(rows: DataFrame, least: int = 3) -> DataFrame:
    """(sample, chrom, pos, base): the most common base of mpileup rows (sample, chrom, pos, ref, bases) with ``least`` reads
    or more, null for fewer; ties go to the first letter."""
    d = rows.select("sample", "chrom", "pos", read_base_counts(F.col("bases"), F.col("ref")).alias("c"))
    top = F.array_max(F.array(*[F.struct(F.col(f"c.{b}").alias("n"), F.lit(-i).alias("o"), F.lit(b).alias("base")) for i, b in enumerate("ACGT")]))
    total = F.col("c.A") + F.col("c.C") + F.col("c.G") + F.col("c.T")
    return d.select("sample", "chrom", "pos", F.when((total >= least) & (top["n"] > 0), top["base"]).alias("base"))


def alignment_metrics(alignments: DataFrame, offsets: DataFrame, ref_len: int) -> DataFrame:
    """(sample, identity, coverage, merged_coverage) of PAF rows (sample, target, target_start, target_end, matches, block) on
    concatenated contigs (contig, offset): coverage sums spans, overlaps counted twice, at most 1; merged doesn't."""
    a = alignments.join(offsets.select(F.col("contig").alias("target"), "offset"), "target")
    a = a.withColumn("start", F.col("target_start") + F.col("offset")).withColumn("end", F.col("target_end") + F.col("offset"))
    m = iv.merge(a, ["sample"]).groupBy("sample").agg((F.sum(F.col("end") - F.col("start")) / ref_len).alias("merged_coverage"))
    g = a.groupBy("sample").agg((F.sum("matches") / F.sum("block")).alias("identity"), F.least(F.sum(F.col("end") - F.col("start")) / ref_len, F.lit(1.0)).alias("coverage"))
    return g.join(m, "sample")


def read_metrics(reads: DataFrame, samples: DataFrame, ref_len: int, min_depth: int) -> DataFrame:
    """(sample, total_reads, mapped_reads, mean_depth, coverage_percent, total_gap_bases) of mapped reads (sample, flag, pos,
    cigar); both read counts are positions under any read, as the finished reports have them."""
    c = coverage(reads, ref_len, ["sample"])
    size = F.col("end") - F.col("start")
    g = c.groupBy("sample").agg(F.sum(size).alias("any"), F.sum(F.col("k") * size).alias("bases"), F.sum(F.when(F.col("k") >= min_depth, size)).alias("deep"))
    out = samples.select("sample").join(g, "sample", "left").na.fill(0, ["any", "bases", "deep"])
    # A minimum of 0 is met without a read.
    deep = F.col("deep") if min_depth > 0 else F.lit(ref_len)
    return out.select("sample", F.col("any").alias("total_reads"), F.col("any").alias("mapped_reads"), (F.col("bases") / ref_len).alias("mean_depth"), (deep / ref_len * 100).alias("coverage_percent"), (F.lit(ref_len) - deep).cast("long").alias("total_gap_bases"))


def reads_as_alignments(metrics: DataFrame, ref_len: int) -> DataFrame:
    """(sample, identity, sample_coverage, reference_coverage, num_alignments, gap_bases) of ``read_metrics`` in the form of
    assembly alignments: identity is 1, each sample one alignment."""
    return metrics.select("sample", F.lit(1.0).alias("identity"), (F.col("coverage_percent") / 100).alias("sample_coverage"), ((F.lit(ref_len) - F.col("total_gap_bases")) / ref_len).alias("reference_coverage"), F.lit(1).cast("long").alias("num_alignments"), F.col("total_gap_bases").alias("gap_bases"))


def averages(alignments: DataFrame) -> DataFrame:
    """One row of means over samples, 0 without any: avg_identity, avg_sample_coverage, avg_reference_coverage."""
    return alignments.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("identity", "sample_coverage", "reference_coverage")])
