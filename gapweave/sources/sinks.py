"""Writers: reports, BED, wide tables, matrices; FASTA is in ``fasta``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_json(report: DataFrame, path: str, compress: bool | None = None) -> None:
    """Writes a report of one row as JSON; a path ending in .gz is compressed."""
    zipped = path.endswith(".gz") if compress is None else compress
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").option("compression", "gzip" if zipped else "none").text(path)


def report_binary(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def bed_lines(regions: DataFrame, chrom: str, *, name: str | None = None, color: str | None = None) -> DataFrame:
    """(value) BED lines of (start, end), 0-based half-open as they are; ``color`` gives the nine-column form."""
    parts = [F.lit(chrom), F.col("start").cast("string"), F.col("end").cast("string")]
    if name:
        parts.append(F.col(name))
    if color:
        parts += [F.lit("0"), F.lit("."), F.col("start").cast("string"), F.col("end").cast("string"), F.col(color)]
    return regions.select(F.concat_ws("\t", *parts).alias("value"))


#: Colours of risk levels in BED files.
RISK_RGB = {"Critical": "255,0,0", "High": "255,128,0", "Medium": "255,255,0", "Low": "0,255,0"}


def bed_files(gaps: DataFrame, chrom: str, path: str) -> None:
    """A folder of BED files by sample."""
    lines = gaps.select("sample", F.concat_ws("\t", F.lit(chrom), F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    lines.sortWithinPartitions("sample", "value").write.mode("overwrite").partitionBy("sample").text(path)


def bed_set(rows: DataFrame, name: Column, chrom: str, label: Column, description, color: str) -> DataFrame:
    """(name, n, start, value) the lines of a BED file for each ``name``, headed by a track line; ``description`` makes its text of the
    numbers of regions and bases, n is 0 for that line."""
    r = rows.withColumn("name", name)
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    lines = r.select("name", F.lit(1).alias("n"), F.col("start").cast("long").alias("start"), F.concat_ws("\t", F.lit(chrom), F.col("start").cast("string"), F.col("end").cast("string"), label).alias("value"))
    heads = r.groupBy("name").agg(F.count(F.lit(1)).alias("regions"), F.sum(size).alias("bases"))
    text = F.concat(F.lit('track name="'), "name", F.lit('" description="'), description(F.col("name"), F.col("regions"), F.col("bases")), F.lit(f'" color={color}'))
    return heads.select("name", F.lit(0).alias("n"), F.lit(0).cast("long").alias("start"), text.alias("value")).unionByName(lines)


#: Colours of the track lines of BED sets by kind, fixed values.
TRACK_RGB = {"unique": "255,0,0", "mm2": "233,69,96", "snippy": "59,130,246", "cfsan": "16,185,129", "snp_only": "234,88,12"}


def bed_sets(chrom: str, unique: DataFrame, gaps: dict[str, DataFrame], snp_only: DataFrame | None = None, only: dict[str, DataFrame] | None = None) -> DataFrame:
    """(name, n, start, value) of all BED files of a report, of its first word as the sequence name.

    ``unique``: (sample, start, end) gapped in one sample alone, all in ALL_UNIQUE_GAPS.  ``gaps``: such rows by kind (mm2, snippy,
    cfsan), a file for each sample.  ``snp_only``: regions that only the callers leave out, used where there are no snippy gaps.
    ``only``: the calls (sample, pos, ref, alt) of one side alone by kind (snippy, cfsan).  A file without rows isn't there."""
    chrom = chrom.split()[0] if chrom.split() else chrom
    regions = lambda kind: lambda name, n, bases: F.concat(F.regexp_replace(name, f"_{kind}_gaps$", ""), F.format_string(f" - {TITLES[kind]} gaps (%d regions, %d bp)", n, bases))
    out = bed_set(unique, F.lit("ALL_UNIQUE_GAPS"), chrom, F.col("sample"), lambda name, n, bases: F.format_string("All unique gaps (%d regions, %d bp total)", n, bases), TRACK_RGB["unique"])
    for kind, rows in gaps.items():
        out = out.unionByName(bed_set(rows, F.concat("sample", F.lit(f"_{kind}_gaps")), chrom, F.lit(f"{kind}_gap"), regions(kind), TRACK_RGB[kind]))
    if snp_only is not None and "snippy" not in gaps:
        text = lambda name, n, bases: F.concat(F.regexp_replace(name, "_snp_only$", ""), F.format_string(" - SNP-only gaps (%d regions, %d bp)", n, bases))
        out = out.unionByName(bed_set(snp_only, F.concat("sample", F.lit("_snp_only")), chrom, F.lit("snp_pipeline_gap"), text, TRACK_RGB["snp_only"]))
    for kind, rows in (only or {}).items():
        shown = F.concat("sample", F.lit(":"), F.coalesce("ref", F.lit("?")), F.lit(">"), F.coalesce("alt", F.lit("?")))
        places = rows.withColumn("start", F.greatest(F.col("pos") - 1, F.lit(0))).withColumn("end", F.col("pos"))
        out = out.unionByName(bed_set(places, F.lit(f"SNP_{TITLES[kind]}_only"), chrom, shown, lambda name, n, bases, kind=kind: F.format_string(f"{TITLES[kind]}-only SNPs (%d positions)", n), TRACK_RGB[kind]))
    return out


TITLES = {"mm2": "mm2", "snippy": "Snippy", "cfsan": "CFSAN"}


def write_bed_sets(rows: DataFrame, path: str) -> None:
    """All files in one pass, a folder ``name=...`` for each with its lines in order by the names of its parts."""
    order = ("name", "n", "start", "value")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def core_wide(core: DataFrame, samples: list[str]) -> DataFrame:
    """``CHR POS REF s1 s2 ...``, positions 1-based; a missing allele is the reference."""
    wide = core.groupBy("chrom", "pos", "ref").pivot("sample", samples).agg(F.first("allele"))
    return wide.select(F.col("chrom").alias("CHR"), (F.col("pos") + 1).alias("POS"), F.col("ref").alias("REF"), *[F.coalesce(F.col(f"`{s}`"), F.col("ref")).alias(s) for s in samples])


def tsv(table: DataFrame, path: str, order: list[str], head: list[str] | None = None) -> None:
    """Cells joined by tabs as they are, never quoted, under one line of names; null is empty.  The rows are dealt to files by
    ranges of ``order``, so the table is the files in the order of their names."""
    cells = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns])
    rows = table.select(F.lit(1).alias("_n"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], cells.alias("value"))
    first = "\t".join(table.columns if head is None else head)
    start = table.sparkSession.createDataFrame([(0, first)], "_n int, value string")
    by = ["_n", *[f"_o{i}" for i in range(len(order))]]
    rows.unionByName(start, allowMissingColumns=True).repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def matrix(pairs_square: DataFrame, samples: list[str], path: str, value: str = "distance") -> None:
    """A distance matrix with an empty corner cell."""
    wide = pairs_square.groupBy("row").pivot("col", samples).agg(F.first(value))
    tsv(wide, path, ["row"], ["", *samples])


def quality_tsv(scored: DataFrame) -> DataFrame:
    """(value) lines of samples with rates in four places."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    return scored.select(F.concat_ws("\t", "sample", four("score"), "recommendation", four("ref_identity"), four("ref_coverage"), four("avg_quality"), F.array_join("flags", ",")).alias("value"))


def quality_report(scored: DataFrame, pairs: DataFrame, reference: DataFrame, samples: DataFrame) -> DataFrame:
    """(part, n, value) the lines of the quality report in order: 1 a row per scored sample, 2 the matrix of gap quality of all ``samples``, 3 the
    reference with the averages of alignments.  ``scored`` has n_contigs beside the columns of ``qc.score``, ``reference``
    one row (reference_name, reference_length, avg_identity, avg_sample_coverage, avg_reference_coverage)."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    flags = F.when(F.size("flags") == 0, "-").otherwise(F.array_join("flags", ","))
    cells = ("sample", four("score"), (F.size("flags") > 0).cast("string"), "recommendation", flags, four("ref_coverage"), four("avg_quality"), F.col("total_unique").cast("string"), F.col("n50").cast("string"), F.col("n_contigs").cast("string"))
    rows = scored.select(F.lit(1).alias("part"), F.concat_ws("\t", F.lit("1"), "sample").alias("n"), F.concat_ws("\t", *cells).alias("value"))
    names = samples.select("sample")
    both = pairs.select(F.col("a").alias("row"), F.col("b").alias("col"), "quality").unionByName(pairs.select(F.col("b").alias("row"), F.col("a").alias("col"), "quality")).unionByName(names.select(F.col("sample").alias("row"), F.col("sample").alias("col"), F.lit(1.0).alias("quality")))
    sorted_cells = F.transform(F.array_sort(F.collect_list(F.struct("col", four("quality").alias("q")))), lambda x: x["q"])
    matrix_rows = both.groupBy("row").agg(F.array_join(sorted_cells, "\t").alias("cells")).select(F.lit(2).alias("part"), F.concat_ws("\t", F.lit("1"), "row").alias("n"), F.concat_ws("\t", "row", "cells").alias("value"))
    head = names.agg(F.array_join(F.array_sort(F.collect_list("sample")), "\t").alias("h")).select(F.lit(2).alias("part"), F.lit("0c").alias("n"), F.concat_ws("\t", F.lit("sample"), "h").alias("value"))
    plain = ("reference_name", "reference_length")
    last = reference.select(F.posexplode(F.array(*[F.concat_ws("\t", F.lit(c), F.col(c).cast("string") if c in plain else four(c)) for c in (*plain, "avg_identity", "avg_sample_coverage", "avg_reference_coverage")])).alias("i", "value")).select(F.lit(3).alias("part"), F.concat(F.lit("1"), F.col("i").cast("string")).alias("n"), "value")
    titles = [(1, "0", "sample\tscore\tflagged\trecommendation\tflags\tref_coverage\tgap_quality\tunique_gaps\tn50\tnum_contigs"), (2, "0a", ""), (2, "0b", "# Gap Quality Matrix (intersection/union)"), (3, "0a", ""), (3, "0b", "# Reference Summary")]
    fixed = scored.sparkSession.createDataFrame(titles, "part int, n string, value string")
    return fixed.unionByName(rows).unionByName(head).unionByName(matrix_rows).unionByName(last)


def write_quality(lines: DataFrame, report: DataFrame, path: str) -> None:
    """The quality report by the ending of the path: .json the report of one row, else the lines."""
    if path.endswith((".json", ".json.gz")):
        report_json(report, path)
    else:
        lines.coalesce(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)
