"""Genomics-shaped views over the star-schema tables, the same in Spark SQL and in ANSI SQL.

They give the registered queries deterministic inputs: a reference sequence with a base per order, gap
intervals from events, calls from line items, annotations from parts, contigs from suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.sources.store import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Calls of a part of a small table, and the most of one of a large table.
PART, LARGEST_PART = 20_000, 400_000
PIPES = "CASE {k} % 3 WHEN 0 THEN 'gt' WHEN 1 THEN 'p1' ELSE 'p2' END"


class Views:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._n = self._lines = None
        self._once: dict[str, DataFrame] = {}

    def once(self, name: str, make) -> DataFrame:
        """The table ``make()`` gives, written at its first use and read from then on."""
        if name not in self._once:
            self._once[name] = stored(make(), name)
        return self._once[name]

    def merged_gaps(self) -> DataFrame:
        return self.once("gaps", lambda: iv.merge(self.gap(), ["pipeline", "sample"]))

    def cover(self) -> DataFrame:
        """Segments of each pipeline and the number k of samples gapped there."""
        return self.once("cover", lambda: iv.sweep(self.merged_gaps(), ["pipeline"]))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def ref_len(self) -> int:
        """Length of the reference: a parquet row count, read from the footers."""
        if self._n is None:
            self._n = self.table("orders").count()
        return self._n

    def ref_base(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS pos", "substr('ACGT', CAST(1 + (o_orderkey * 7 + o_orderkey div 3) % 4 AS INT), 1) AS base")

    @property
    def parts(self) -> int:
        """Parts of the calls: their number grows with the table, so that a part, and the memory of its task, does not."""
        if self._lines is None:
            self._lines = self.table("lineitem").count()
        some = min(self.spark.sparkContext.defaultParallelism, self._lines // PART + 1)
        return max(some, self._lines // LARGEST_PART + 1)

    def dealt(self, calls: DataFrame, by: str = "pos") -> DataFrame:
        """Calls dealt to parts, by position unless another column is named.  What groups them by it and more stays in these parts."""
        return calls.repartition(self.parts, by)

    def gap(self) -> DataFrame:
        n = self.ref_len
        e = self.table("events")
        start = f"CAST(floor(value * 100) AS BIGINT) % {n}"
        return e.selectExpr(f"{PIPES.format(k='event_id')} AS pipeline", "concat('S', CAST(user_id % 6 AS STRING)) AS sample", f"{start} AS start", f"least({start} + 1 + event_id % 37, {n}) AS end")

    def call(self, width: int | None = None) -> DataFrame:
        """The calls, dealt by position; with a ``width`` they have the ``bin`` of their position and are dealt by that."""
        lines = self.table("lineitem").selectExpr(
            f"{PIPES.format(k='l_linenumber')} AS pipeline",
            "concat('S', CAST(l_suppkey % 6 AS STRING)) AS sample",
            "l_orderkey AS pos",
            "substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS alt",
            "l_quantity * 4 AS qual",
            "CAST(l_linenumber * 7 AS BIGINT) AS dp",
        )
        by = ["pos"]
        if width is not None:
            lines, by = lines.withColumn("bin", iv.bin_of("pos", width)), ["bin", "pos"]
        return self.dealt(lines, by[0]).groupBy("pipeline", "sample", *by).agg(F.expr("char(min(ascii(alt)))").alias("alt"), F.max("qual").alias("qual"), F.max("dp").alias("dp"))

    def carriers(self) -> DataFrame:
        """(pipeline, sample) of the calls."""
        return self.table("lineitem").selectExpr(f"{PIPES.format(k='l_linenumber')} AS pipeline", "concat('S', CAST(l_suppkey % 6 AS STRING)) AS sample").distinct()

    def samples(self) -> DataFrame:
        return self.spark.createDataFrame([(f"S{i}",) for i in range(6)], "sample string")

    def feature(self) -> DataFrame:
        n = self.ref_len
        return self.table("part").selectExpr(
            "'c1' AS seqid",
            "CASE p_partkey % 2 WHEN 0 THEN 'gene' ELSE 'CDS' END AS feature_type",
            f"p_partkey * 31 % {n} + 1 AS start",
            f"least(p_partkey * 31 % {n} + 1 + p_size, CAST({n} AS BIGINT)) AS end",
            "concat('g', CAST(p_partkey div 2 AS STRING)) AS gene",
            "p_brand AS product",
        )

    def contig(self) -> DataFrame:
        return self.table("supplier").selectExpr("concat('S', CAST(s_nationkey % 6 AS STRING)) AS sample", "concat('c', CAST(s_suppkey AS STRING)) AS contig", "CAST(s_suppkey AS INT) AS contig_idx", "CAST(100 + s_suppkey * 13 % 1000 AS BIGINT) AS length")


#: The same in SQL, as the head of an oracle query.
SQL = f"""
n AS (SELECT count(*) AS n FROM orders),
ref_base AS (SELECT o_orderkey AS pos, substr('ACGT', CAST(1 + (o_orderkey * 7 + o_orderkey // 3) % 4 AS INT), 1) AS base FROM orders),
gap AS (
  SELECT {PIPES.format(k="event_id")} AS pipeline, 'S' || CAST(user_id % 6 AS VARCHAR) AS sample,
         CAST(floor(value * 100) AS BIGINT) % n AS s, least(CAST(floor(value * 100) AS BIGINT) % n + 1 + event_id % 37, n) AS e
  FROM events, n
),
call AS (
  SELECT pipeline, sample, pos, min(alt) AS alt, max(qual) AS qual, max(dp) AS dp FROM (
    SELECT {PIPES.format(k="l_linenumber")} AS pipeline, 'S' || CAST(l_suppkey % 6 AS VARCHAR) AS sample, l_orderkey AS pos,
           substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS alt, l_quantity * 4 AS qual, CAST(l_linenumber * 7 AS BIGINT) AS dp
    FROM lineitem) GROUP BY pipeline, sample, pos
),
smp AS (SELECT 'S' || CAST(range AS VARCHAR) AS sample FROM range(6)),
pipe AS (SELECT unnest(['gt', 'p1', 'p2']) AS pipeline),
feature AS (
  SELECT CASE p_partkey % 2 WHEN 0 THEN 'gene' ELSE 'CDS' END AS feature_type, p_partkey * 31 % n + 1 AS s, least(p_partkey * 31 % n + 1 + p_size, n) AS e,
         'g' || CAST(p_partkey // 2 AS VARCHAR) AS gene, p_brand AS product FROM part, n
),
contig AS (
  SELECT 'S' || CAST(s_nationkey % 6 AS VARCHAR) AS sample, 'c' || CAST(s_suppkey AS VARCHAR) AS contig, CAST(s_suppkey AS INT) AS contig_idx,
         CAST(100 + s_suppkey * 13 % 1000 AS BIGINT) AS length FROM supplier
),
gp AS (SELECT DISTINCT pipeline, sample, unnest(range(s, e)) AS pos FROM gap),
gk AS (SELECT pipeline, pos, count(*) AS k FROM gp GROUP BY pipeline, pos),
snp AS (SELECT c.pipeline, c.sample, c.pos, c.alt, r.base FROM call c JOIN ref_base r USING (pos) WHERE c.alt <> r.base),
site AS (SELECT DISTINCT pipeline, pos FROM snp),
dense AS (
  SELECT t.pipeline, t.pos, m.sample, r.base, g.pos IS NOT NULL AS gapped, s.alt, coalesce(s.alt, r.base) AS allele
  FROM site t CROSS JOIN smp m JOIN ref_base r ON r.pos = t.pos
  LEFT JOIN gp g ON g.pipeline = t.pipeline AND g.sample = m.sample AND g.pos = t.pos
  LEFT JOIN snp s ON s.pipeline = t.pipeline AND s.sample = m.sample AND s.pos = t.pos
)
"""


def oracle(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([SQL, *ctes]) + body
