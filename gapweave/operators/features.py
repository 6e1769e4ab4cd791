"""Annotated features in gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import callsets


def display_name():
    return F.coalesce(F.col("gene"), F.col("locus_tag"), F.col("id"), F.concat(F.col("seqid"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def affected(features: DataFrame, gaps: DataFrame, types=("gene", "CDS")) -> DataFrame:
    """(sample, name, feature_type, product, start, overlap_bp, overlap_pct): for each sample and display name the feature and gap
    with the largest share of the feature gone.  Features are 1-based inclusive, gaps 0-based half-open; gaps count
    one by one, and names are one across types.  Ties: the longer overlap, then gene before CDS, then the place."""
    f = features.where(F.col("feature_type").isin(*types))
    f = f.select(F.col("name"), "feature_type", F.col("product"), (F.col("start") - 1).alias("start"), "end")
    hit = iv.overlapping(f, gaps.select("sample", "start", "end"), ["sample"])
    size = iv.overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    hit = hit.withColumn("overlap_bp", size).withColumn("overlap_pct", F.col("overlap_bp") / (F.col("end") - F.col("start")) * 100)
    w = Window.partitionBy("sample", "name").orderBy(F.desc("overlap_pct"), F.desc("overlap_bp"), F.desc("feature_type"), "start", "r_start")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("sample", "name", "feature_type", "product", "start", "overlap_bp", "overlap_pct")


#: The columns that the table of genes is sorted by; texts without regard to case.
SORTS = {"gene": "name", "product": "product", "sample": "sample", "position": "start", "overlap": "overlap_pct"}
TEXTS = ("gene", "product", "sample")


def table_pages(hit: DataFrame, by: str, ascending: bool = True, size: int = 50) -> DataFrame:
    """The rows of ``affected`` with ``place`` and ``page`` by gene, product, sample, position or overlap; a missing product is the
    empty text, ties go by sample and name."""
    if by not in SORTS:
        raise ValueError(f"the table is sorted by one of {sorted(SORTS)}")
    key = F.col(SORTS[by])
    key = F.lower(F.coalesce(key, F.lit(""))) if by in TEXTS else key
    return callsets.pages(hit.withColumn("_key", key), [("_key", ascending), ("sample", True), ("name", True)], size).drop("_key")


def zones(hit: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, affected_genes, affected_cds, removed_genes, significantly_affected): gone from 99.9 % and 50 % on."""
    gene = F.col("feature_type") == "gene"
    g = hit.groupBy("sample").agg(
        F.count_if(gene).alias("affected_genes"), F.count_if(F.col("feature_type") == "CDS").alias("affected_cds"), F.count_if(gene & (F.col("overlap_pct") >= 99.9)).alias("removed_genes"), F.count_if(gene & (F.col("overlap_pct") >= 50)).alias("significantly_affected")
    )
    cols = ("affected_genes", "affected_cds", "removed_genes", "significantly_affected")
    return samples.join(g, "sample", "left").select("sample", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


def search(hit: DataFrame, sample: str = "all", text: str = "") -> DataFrame:
    """Rows of a sample whose gene or product contains a text, in any case."""
    out = hit if sample == "all" else hit.where(F.col("sample") == sample)
    if text:
        low = F.lit(text.lower())
        out = out.where(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("product", F.lit(""))), low))
    return out
