"""Readers of text formats.  Each gives a DataFrame in the catalog's coordinates: 0-based, half-open.

Files are read by Spark's text source, so compressed files, folders and globs work, and every line is
parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.functions import variants as va
from gapweave.sources import fasta as fa


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, n, line): n orders the lines of a file.  Lines that are already a table go through as they are."""
    if isinstance(path, DataFrame):
        return path
    t = spark.read.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file of a folder by name."""
    files = sorted(spark.read.text(path).inputFiles())
    row = spark.read.text(files[0]).first() if files else None
    return row[0] if row is not None else ""


def _fields(df: DataFrame, least: int) -> DataFrame:
    """Adds ``f``, the cells of the lines that have enough of them.  A generator makes it: a projected split would be copied into
    every filter and cell that reads it, the making of the line along with it."""
    return df.withColumn("f", F.explode(F.filter(F.array(F.split("line", "\t")), lambda f: F.size(f) >= least)))


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def fasta(spark: SparkSession, path, upper: bool = True) -> DataFrame:
    """(sample, contig, contig_idx, length, sequence) of FASTA records; the sample is the file name without
    .gz and .fa, .fasta or .fna.  A record is a row here, so records must fit into one; ``fasta.chunks`` has no such bound."""
    keys = ("sample", "contig", "contig_idx")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bases"))), lambda x: x["bases"]), "")
    return fa.chunks(spark, path, upper).groupBy("unit", *keys).agg(whole.alias("sequence")).select(*keys, F.length("sequence").cast("long").alias("length"), "sequence")


def reference(spark: SparkSession, path) -> DataFrame:
    """One row (name, length, sequence): all records joined, named by the last one, case as it is.  For sequences that fit into a
    row; ``fasta.base_rows`` and ``fasta.lines`` take chunks."""
    return fasta(spark, path, upper=False).groupBy().agg(
        F.max_by("contig", "contig_idx").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig_idx", "sequence"))), lambda x: x["sequence"]), "").alias("sequence")
    ).select("name", F.length("sequence").cast("long").alias("length"), "sequence")


def _chunks(contigs: DataFrame) -> DataFrame:
    return contigs if "bases" in contigs.columns else fa.cut(contigs)


def ref_base(contigs: DataFrame) -> DataFrame:
    """(pos, base) over the concatenation of records or chunks, upper-cased."""
    return fa.base_rows(_chunks(contigs))


def vcf_rows(spark: SparkSession, path) -> DataFrame:
    """The columns of data lines with 8 fields or more, the file and line number, and ``at`` where tables of lines have it."""
    rows = _fields(lines(spark, path).where("NOT startswith(line, '#')"), 8)
    names = ("chrom", "pos_text", "id", "ref", "alt", "qual_text", "filter", "info")
    return rows.select("file", "n", *[c for c in rows.columns if c == "at"], *[_f(i).alias(x) for i, x in enumerate(names)], _f(8).alias("format"), _f(9).alias("call"))


def vcf_calls(spark: SparkSession, path, min_qual: float = 0.0, include_indels: bool = False) -> DataFrame:
    """Calls for the comparison of pipelines: (file, chrom, pos, ref, alt, qual, dp, mnp, n, i).  Lines that repeat a position all
    come back; n and i, the line and the place in an MNP, tell ``sites.last_calls`` which is the last.

    CHROM and FILTER play no part; a QUAL of a dot passes and counts 0; MNPs (equal lengths over 1, commas not
    looked at) give a row for each differing base; other lengths are indels; position 0 or worse is dropped."""
    v = vcf_rows(spark, path).where(va.quality_passes("qual_text", min_qual))
    v = v.withColumn("p", F.col("pos_text").try_cast("long")).where("p >= 1").withColumn("q", va.quality("qual_text"))
    depth = F.coalesce(va.info_depth("info"), va.format_value("format", "call", "DP").try_cast("long"), va.format_value("format", "call", "SDP").try_cast("long"), F.lit(0))
    same = F.length("ref") == F.length("alt")
    v = v.where(same | F.lit(include_indels)).withColumn("dp", depth)
    mnp = same & (F.length("ref") > 1)
    parts = F.when(mnp, va.decompose("p", "ref", "alt")).otherwise(F.array(F.struct(F.col("p").alias("pos"), "ref", "alt")))
    v = v.withColumn("mnp", mnp).select("file", "chrom", F.posexplode(parts).alias("i", "x"), F.col("q").alias("qual"), "dp", "mnp", "n")
    return v.select("file", "chrom", (F.col("x.pos") - 1).alias("pos"), "x.ref", "x.alt", "qual", "dp", "mnp", "n", "i")


def vcf_variants(spark: SparkSession, path) -> DataFrame:
    """Calls for quality control: (sample, chrom, pos 1-based, ref, alt, qual, filter, info, depth, af, ro, ao, gq, gt, qa, abq, pval), MNPs
    decomposed where the alt has no comma, and of each chrom and pos the last line.  Of lines with one number, which only tables of
    lines have, the first by their column ``at`` counts, else the first as they are read, so the result doesn't hang on the order in
    which a shuffle delivers them; Spark reads larger files first, so tables of several files need ``at``."""
    from pyspark.sql import Window

    v = vcf_rows(spark, path)
    v = v.withColumn("_at", F.col("at") if "at" in v.columns else F.monotonically_increasing_id()).withColumn("pos", F.col("pos_text").try_cast("long")).where("pos IS NOT NULL")
    mnp = va.is_mnp("ref", "alt")
    parts = F.when(mnp, va.decompose("pos", "ref", "alt")).otherwise(F.array(F.struct("pos", "ref", "alt")))
    info = F.when(mnp, F.concat("info", F.lit(";DECOMPOSED_FROM_MNP="), "ref", F.lit(">"), "alt")).otherwise(F.col("info"))
    v = v.withColumn("info2", info).select("*", F.explode(parts).alias("x"))
    v = v.withColumn("f", va.format_fields("format", "call"))
    af = F.coalesce("f.af", va.info_number("info", "AF", "double"))
    depth = F.coalesce("f.depth", va.info_number("info", "DP"))
    w = Window.partitionBy("file", "chrom", "x.pos").orderBy(F.desc("n"), "_at")
    v = v.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return v.select(
        sample_name(F.col("file")).alias("sample"), "chrom", F.col("x.pos").alias("pos"), F.col("x.ref").alias("ref"), F.col("x.alt").alias("alt"), va.quality("qual_text").alias("qual"), "filter", F.col("info2").alias("info"),
        depth.alias("depth"), af.alias("af"), F.coalesce("f.ro", va.info_number("info", "RO")).alias("ro"), F.coalesce("f.ao", va.info_number("info", "AO")).alias("ao"), "f.gq", "f.gt", "f.qa", "f.abq", "f.pval",
    )


def vcf_folder(spark: SparkSession, folder: str, pipeline: str = "") -> list[str]:
    """The files of a folder of calls: samples/*/var.flt.vcf for cfsan, *.vcf, and of each *_snippy folder the first of
    snps.vcf, snps.filt.vcf, <folder>.vcf and any other that is neither raw, subs nor filt.  Only names are read."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.vcf").option("recursiveFileLookup", "true").load(folder).select("path")
    base = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("parent"), F.regexp_replace("path", "/[^/]*$", "").alias("place"))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    inside = base.withColumn("below", F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z0-9]+:/*", "")), f"/{root}/", -1)).withColumn("depth", F.size(F.split("below", "/")))
    snippy = (F.col("depth") == 2) & F.endswith("parent", F.lit("_snippy"))
    rest = ~F.col("name").rlike(r"\.(raw|subs|filt)\.vcf$")
    rank = F.when(F.col("name") == "snps.vcf", 0).when(F.col("name") == "snps.filt.vcf", 1).when(F.col("name") == F.concat("parent", F.lit(".vcf")), 2).when(rest, 3)
    first = inside.where(snippy).withColumn("rank", rank).where("rank IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("rank", "name"))).where("r = 1")
    flat = inside.where("depth = 1")
    if pipeline == "cfsan":
        flat = flat.unionByName(inside.where("depth = 3 AND startswith(below, 'samples/') AND name = 'var.flt.vcf'"))
    return [r[0] for r in flat.select("path").unionByName(first.select("path")).orderBy("path").collect()]


def viewer_snps(spark: SparkSession, path, style: str) -> DataFrame:
    """(file, pos 1-based, ref, alt, qual, depth) as the report pages read calls.  ``snippy``: INFO with TYPE=ins or TYPE=del
    drops out, the shorter of both alleles is walked, depth is DP.  ``cfsan``: ten columns, equal lengths, depth is ADP and
    stands for the quality.  An unreadable position is 0."""
    if style not in ("snippy", "cfsan"):
        raise ValueError("style is snippy or cfsan")
    v = vcf_rows(spark, path)
    if style == "snippy":
        v = v.where("NOT contains(info, 'TYPE=ins') AND NOT contains(info, 'TYPE=del')")
    else:
        v = v.where("call IS NOT NULL AND length(ref) = length(alt)")
    key = "DP=" if style == "snippy" else "ADP="
    first = F.get(F.filter(F.split("info", ";"), lambda x: F.startswith(x, F.lit(key))), F.lit(0))
    depth = F.coalesce(first.substr(F.lit(len(key) + 1), F.length("info")).try_cast("long"), F.lit(0).cast("long"))
    v = v.withColumn("depth", depth).withColumn("p", F.coalesce(F.col("pos_text").try_cast("long"), F.lit(0)))
    v = v.withColumn("qual", va.quality("qual_text") if style == "snippy" else F.col("depth").cast("double"))
    v = v.withColumn("n_both", F.least(F.length("ref"), F.length("alt"))).withColumn("r", F.expr("substr(ref, 1, n_both)")).withColumn("a", F.expr("substr(alt, 1, n_both)")).where("n_both > 0")
    return v.select("file", F.explode(va.decompose("p", "r", "a")).alias("x"), "qual", "depth").select("file", "x.pos", "x.ref", "x.alt", "qual", "depth")


def sample_name(file: Column) -> Column:
    """The parent folder of var.flt.vcf and consensus.vcf, else the file name without its known endings."""
    base = F.element_at(F.split(file, "/"), -1)
    parent = F.coalesce(F.try_element_at(F.split(file, "/"), F.lit(-2)), F.lit(""))
    return F.when(base.isin("var.flt.vcf", "consensus.vcf"), parent).otherwise(F.regexp_replace(base, r"(\.filt|\.raw|\.subs)?\.vcf(\.gz)?$", ""))


def core_tsv(spark: SparkSession, path, pipeline: str = "") -> DataFrame:
    """Long form (pipeline, chrom, pos, ref, sample, allele, n, i) of a wide ``CHR POS REF s1 s2 ...`` table; repeated
    ``_snippy`` endings of sample names go, rows with under 4 columns or position 0 too.  n is the line, i the column."""
    head = first_line(spark, path)
    if not head.startswith("CHR\t"):
        raise ValueError(f"{path} has no CHR header parted by tabs")
    names = F.array(*[F.lit(x) for x in head.rstrip("\r\n").split("\t")[3:]])
    rows = _fields(lines(spark, path).where("NOT startswith(line, 'CHR\t')"), 4)
    z = F.arrays_zip(names.alias("s"), F.slice("f", F.lit(4), F.size("f")).alias("a"))
    out = rows.withColumn("p", _f(1).try_cast("long")).where("p >= 1").select("n", _f(0).alias("chrom"), (F.col("p") - 1).alias("pos"), _f(2).alias("ref"), F.posexplode(z).alias("i", "x"))
    return out.where("x.s IS NOT NULL AND x.a IS NOT NULL").select(F.lit(pipeline).alias("pipeline"), "chrom", "pos", "ref", va.strip_suffix(F.col("x.s"), "_snippy").alias("sample"), F.col("x.a").alias("allele"), "n", "i")


#: Readers of core-allele tables by what their first line starts with; ``datasource`` has the same table as a format of Spark's.
CORE_READERS = {"CHR\t": core_tsv}


def core_snps(spark: SparkSession, path, pipeline: str = "") -> DataFrame:
    """Reads a core-allele table with the first reader that knows its header."""
    head = first_line(spark, path)
    for start, reader in CORE_READERS.items():
        if head.startswith(start):
            return reader(spark, path, pipeline)
    raise ValueError(f"no reader knows the header of {path}")


def depth(spark: SparkSession, path) -> DataFrame:
    """(pos 1-based, depth) of ``contig pos depth`` lines; the contig plays no part."""
    return _fields(lines(spark, path), 3).select(_f(1).try_cast("long").alias("pos"), _f(2).try_cast("long").alias("depth")).where("pos IS NOT NULL AND depth IS NOT NULL")


def depth_gaps(spark: SparkSession, path, min_depth: int = 1) -> DataFrame:
    """(start, end) 1-based half-open: runs of positions under the minimum depth."""
    return iv.depth_gaps(depth(spark, path), [], min_depth)


def zero_depth_gaps(spark: SparkSession, path) -> DataFrame:
    """(sample, start, end) 1-based half-open of pileup lines whose fourth column is 0."""
    t = _fields(lines(spark, path), 4)
    t = t.select(F.try_element_at(F.split("file", "/"), F.lit(-2)).alias("sample"), _f(1).try_cast("long").alias("pos"), _f(3).try_cast("long").alias("d")).where("d = 0 AND pos IS NOT NULL")
    return iv.regions(t, ["sample"])


def masked_positions(contigs: DataFrame) -> DataFrame:
    """(sample, pos) 0-based of N in aligned sequences (records or chunks), over the concatenation."""
    return fa.masked_positions(_chunks(contigs))


def masked_gaps(contigs: DataFrame) -> DataFrame:
    """(sample, start, end) 1-based half-open runs of N."""
    return fa.masked_gaps(_chunks(contigs))


def paf(spark: SparkSession, path) -> DataFrame:
    """Alignments with 12 fields or more; a number that doesn't parse drops the row."""
    num = {1: "query_len", 2: "query_start", 3: "query_end", 6: "target_len", 7: "target_start", 8: "target_end", 9: "matches", 10: "block", 11: "mapq"}
    t = _fields(lines(spark, path), 12).select("file", _f(0).alias("query"), _f(4).alias("strand"), _f(5).alias("target"), *[_f(i).try_cast("long").alias(c) for i, c in num.items()])
    return t.dropna(subset=list(num.values()))


def sam(spark: SparkSession, path) -> DataFrame:
    """(name, flag, contig, pos 1-based, cigar, seq) of alignment lines."""
    t = _fields(lines(spark, path).where("NOT startswith(line, '@')"), 11)
    return t.select(_f(0).alias("name"), _f(1).try_cast("int").alias("flag"), _f(2).alias("contig"), _f(3).try_cast("long").alias("pos"), _f(5).alias("cigar"), _f(9).alias("seq")).dropna(subset=["flag", "pos"])


def gff(spark: SparkSession, path) -> DataFrame:
    """Features, 1-based inclusive, of GFF3 or GTF lines with 9 fields."""
    t = _fields(lines(spark, path).where("NOT startswith(line, '#')"), 9)
    a = _f(8)
    gene = F.coalesce(va.gff_attribute(a, "gene"), va.gff_attribute(a, "Name"))
    locus = va.gff_attribute(a, "locus_tag")
    return t.select(_f(0).alias("seqid"), _f(2).alias("feature_type"), _f(3).try_cast("long").alias("start"), _f(4).try_cast("long").alias("end"), _f(6).alias("strand"), gene.alias("gene"), locus.alias("locus_tag"), va.gff_attribute(a, "product").alias("product"), va.gff_attribute(a, "ID").alias("id")).dropna(subset=["start", "end"])


def sequence_regions(spark: SparkSession, path) -> DataFrame:
    """(seqid, start, end) of ##sequence-region lines."""
    f = F.split("line", r"\s+")
    return lines(spark, path).where("startswith(line, '##sequence-region')").select(F.get(f, F.lit(1)).alias("seqid"), F.get(f, F.lit(2)).try_cast("long").alias("start"), F.get(f, F.lit(3)).try_cast("long").alias("end"))


def core_stats(spark: SparkSession, path) -> DataFrame:
    """(sample, length, aligned, unaligned, variant, het, masked, lowcov) of a core statistics table."""
    t = _fields(lines(spark, path).where("NOT startswith(line, 'ID\t') AND trim(line) != ''"), 8)
    names = ("length", "aligned", "unaligned", "variant", "het", "masked", "lowcov")
    return t.where("f[0] != 'Reference'").select(va.strip_suffix(_f(0), "_snippy").alias("sample"), *[_f(i + 1).try_cast("long").alias(c) for i, c in enumerate(names)])


def snp_metrics(spark: SparkSession, path) -> DataFrame:
    """(sample, percent_mapped, depth, snps, missing) of a metrics table with 16 columns or more, quotes trimmed."""
    t = _fields(lines(spark, path).where("NOT startswith(lower(line), 'sample')"), 16)
    q = lambda i: F.regexp_replace(_f(i), '^"+|"+$', "")
    return t.select(q(0).alias("sample"), q(7).try_cast("double").alias("percent_mapped"), q(10).try_cast("double").alias("depth"), q(13).try_cast("long").alias("snps"), q(15).try_cast("long").alias("missing"))


def snp_list(spark: SparkSession, path) -> DataFrame:
    """(sample, chrom, pos 0-based) of ``chrom pos n sample...`` lines."""
    t = _fields(lines(spark, path), 4).withColumn("p", _f(1).try_cast("long")).where("p >= 1")
    return t.select(F.explode(F.slice("f", F.lit(4), F.size("f"))).alias("sample"), _f(0).alias("chrom"), (F.col("p") - 1).alias("pos")).where("sample != ''")


def distance_matrix(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Long (row, col, distance) of a matrix file; a cell that doesn't parse counts 0.  ``strict`` drops rows of
    another width and fails if the number of rows isn't that of samples; else ``_snippy`` endings go."""
    head = first_line(spark, path)
    names = [x.strip() for x in head.split("\t")[1:]]
    t = lines(spark, path).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 2).where(F.col("line") != head)
    if strict:
        t = t.where(F.size("f") == len(names) + 1)
        if t.count() != len(names):
            raise ValueError(f"{path} is not square")
    z = F.arrays_zip(F.array(*[F.lit(x) for x in names]).cast("array<string>").alias("c"), F.slice("f", F.lit(2), F.size("f")).alias("v"))
    out = t.select(F.trim(_f(0)).alias("row"), F.explode(z).alias("x")).where("x.c IS NOT NULL")
    name = (lambda c: c) if strict else (lambda c: va.strip_suffix(c, "_snippy"))
    return out.select(name(F.col("row")).alias("row"), name(F.col("x.c")).alias("col"), F.coalesce(F.trim("x.v").try_cast("long"), F.lit(0)).alias("distance"))


def names_below(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, parent, depth) of all files below a folder; only names are read, depth is 1 in the folder itself."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    bare = F.regexp_replace("path", "^[a-z0-9]+:/*", "")
    parts = F.split(bare, "/")
    depth = F.size(parts) - len([p for p in root.split("/") if p])
    return found.select("path", F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("parent"), depth.alias("depth"))


def first_named(spark: SparkSession, folder: str, names: tuple[str, ...] | list[str]) -> str | None:
    """The file of a folder that has the first of these names."""
    order = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("name"))
    row = names_below(spark, folder).where("depth = 1").withColumn("o", order).where("o > 0").orderBy("o").first()
    return row.path if row else None


#: Where callers put their matrices, and a report its reference, in the order in which they are looked for: fixed values.
MATRIX_NAMES = {
    "snippy": ("hamming_distances_vanilla.tsv", "hamming_distances_filtered.tsv", "core.dist.tsv"),
    "cfsan": ("snp_distance_matrix.tsv", "snp_distance_matrix_preserved.tsv"),
}
REFERENCE_NAMES = ("reference.fa", "reference.fasta", "ref.fa", "ref.fasta")


def find_matrix(spark: SparkSession, folder: str, caller: str) -> DataFrame | None:
    """The distance matrix of a caller's folder, the first file by name, its shape unchecked; nothing without one."""
    path = first_named(spark, folder, MATRIX_NAMES[caller])
    return None if path is None else distance_matrix(spark, path, strict=False)


def alignment_files(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, path): of each folder with .bam files at any depth, whose name is the sample's, the file most processed by its name:
    indelrealigned before deduped before sorted before others; ties go to the first path."""
    from pyspark.sql import Window

    n = F.col("name")
    rank = F.when(F.contains(n, F.lit("indelrealigned")), 4).when(F.contains(n, F.lit("deduped")), 3).when(F.contains(n, F.lit("sorted")) & ~F.contains(n, F.lit("unsorted")), 2).otherwise(1)
    found = names_below(spark, folder).where(F.endswith("name", F.lit(".bam"))).withColumn("rank", rank)
    best = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("rank"), "path"))
    return found.withColumn("r", best).where("r = 1").select(F.col("parent").alias("sample"), "path")


def report(spark: SparkSession, path) -> DataFrame:
    """A finished report, one row."""
    return spark.read.json(path, multiLine=True)


def report_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """Chunks of the reference beside a report, the first of REFERENCE_NAMES in its folder; nothing without one."""
    found = first_named(spark, path.rsplit("/", 1)[0], REFERENCE_NAMES)
    return None if found is None else fa.chunks(spark, found)
