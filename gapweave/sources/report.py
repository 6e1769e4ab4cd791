"""Finished reports taken apart into the relations that the reader's statistics work on.

Two forms are read: a report document, one nested object (parsed by its schema, data as maps by sample and pipeline), and the
folder form of ``Comparison.write``, whose calls, gaps and reference are lines of JSON beside the report of one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave import schema
from gapweave.sources import fasta

#: The parts of a report document that the reader needs; what else it has is not read.
DOCUMENT = """
version string,
reference struct<name: string, label: string, sequence: string, length: bigint>,
samples map<string, struct<label: string>>,
pipelines map<string, struct<label: string, command: string, has_vcf: boolean, has_bam: boolean, reference: boolean, from_bam_pileup: boolean>>,
data map<string, map<string, struct<gaps: array<array<bigint>>, snps: array<struct<pos: bigint, ref: string, alt: string, qual: double, depth: bigint>>, vcf_path: string, bam_path: string>>>,
summary struct<generated_at: string, warnings: array<string>>
"""
DATA = "sample string, pipeline string, kind string, start long, end long, ref string, alt string, qual double, dp long, n long, i int"


@dataclass
class Loaded:
    """``samples`` (sample, label), ``pipelines`` (place and the columns of schema.PIPELINE; the truth first, then by name), ``calls``
    (pipeline, sample, pos 0-based, ref, alt, qual, dp, n, i), ``gaps`` (pipeline, sample, start, end) as in the report,
    ``ref_base`` (pos, base), ``warnings`` (text), ``files`` (sample, pipeline, vcf_path, bam_path), the truth and the length."""

    samples: DataFrame
    pipelines: DataFrame
    calls: DataFrame
    gaps: DataFrame
    ref_base: DataFrame
    warnings: DataFrame
    files: DataFrame
    truth_id: str | None
    ref_len: int

    def sorted_calls(self) -> DataFrame:
        """The calls with their first letter, in the order of a lookup: by sample, pipeline and position."""
        first = F.coalesce(F.nullif(F.substring("alt", 1, 1), F.lit("")), F.lit("N"))
        return self.calls.withColumn("alt", first).orderBy("sample", "pipeline", "pos", "n", "i")


def _placed(pipelines: DataFrame) -> DataFrame:
    """The first truth by name first, then by name.  A row for each pipeline."""
    from pyspark.sql import Window

    flagged = pipelines.withColumn("reference", F.coalesce("reference", F.lit(False)))
    truth = F.min(F.when(F.col("reference"), F.col("pipeline"))).over(Window.partitionBy(F.lit(0)))
    own = flagged.withColumn("_t", F.coalesce(F.col("pipeline") != truth, F.lit(True)))
    return own.withColumn("place", F.row_number().over(Window.orderBy("_t", "pipeline")) - 1).drop("_t")


def _truth(pipelines: DataFrame) -> str | None:
    row = pipelines.where("reference").orderBy("place").first()
    return row.pipeline if row else None


def document(spark: SparkSession, path: str) -> Loaded:
    """A report document.  It is one row, as the format has it, and must fit into one; its calls and gaps are rows again."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    entries = lambda c, names: doc.select(F.explode(F.map_entries(c)).alias("e")).select(*names)
    samples = entries("samples", [F.col("e.key").alias("sample"), F.col("e.value.label").alias("label")])
    fields = [f.strip().split()[0] for f in schema.PIPELINE.split(",")][1:]
    pipelines = _placed(entries("pipelines", [F.col("e.key").alias("pipeline"), *[F.col(f"e.value.{f}").alias(f) for f in fields]]))
    each = doc.select(F.explode("data").alias("sample", "by")).select("sample", F.explode("by").alias("pipeline", "d"))
    snps = each.select("pipeline", "sample", F.posexplode("d.snps").alias("i", "s"))
    calls = snps.select("pipeline", "sample", (F.col("s.pos") - 1).alias("pos"), "s.ref", "s.alt", "s.qual", F.col("s.depth").alias("dp"), F.lit(0).cast("long").alias("n"), "i")
    gaps = each.select("pipeline", "sample", F.explode("d.gaps").alias("g")).select("pipeline", "sample", F.get("g", F.lit(0)).alias("start"), F.get("g", F.lit(1)).alias("end"))
    ref = doc.select(F.lit("r").alias("sample"), F.lit("r").alias("contig"), F.lit(0).alias("contig_idx"), F.coalesce("reference.sequence", F.lit("")).alias("sequence"))
    head = doc.select(F.coalesce("reference.length", F.length("reference.sequence").cast("long"), F.lit(0)).alias("n")).first()
    warnings = doc.select(F.explode("summary.warnings").alias("text"))
    files = each.select("sample", "pipeline", "d.vcf_path", "d.bam_path")
    # Letters stay as the report has them: comparison is byte-exact.
    bases = fasta.unpacked(fasta.placed(fasta.cut(ref), []))
    return Loaded(samples, pipelines, calls, gaps, bases, warnings, files, _truth(pipelines), head.n if head else 0)


def written(spark: SparkSession, path: str) -> Loaded:
    """The folder form: ``path`` the report, ``path.data`` the calls and gaps, ``path.reference`` the sequence in chunks."""
    doc = spark.read.json(path, multiLine=True)
    rows = lambda c, ddl: doc.select(F.inline(F.from_json(F.to_json(c), f"array<struct<{ddl}>>")))
    samples = rows("samples", "sample: string, label: string")
    pipelines = _placed(rows("pipelines", ", ".join(f.strip().replace(" ", ": ", 1) for f in schema.PIPELINE.split(","))))
    data = spark.read.schema(DATA).json(f"{path}.data")
    calls = data.where("kind = 'snp'").select("pipeline", "sample", (F.col("start") - 1).alias("pos"), "ref", "alt", "qual", "dp", "n", "i")
    gaps = data.where("kind = 'gap'").select("pipeline", "sample", "start", "end")
    chunks = spark.read.schema("start long, bases string").json(f"{path}.reference")
    ref_base = fasta.unpacked(chunks)
    text = doc.select(F.explode("warnings").alias("text")) if "warnings" in doc.columns else spark.createDataFrame([], "text string")
    files = spark.createDataFrame([], "sample string, pipeline string, vcf_path string, bam_path string")
    return Loaded(samples, pipelines, calls, gaps, ref_base, text, files, _truth(pipelines), doc.select("ref_length").first()[0])
