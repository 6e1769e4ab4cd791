"""Calls that arrive as files: each batch of new files is counted into per-pipeline totals.

An extension: the batch engine has no streaming semantics of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def call_counts(spark: SparkSession, folder: str, schema: str = "pipeline string, sample string, pos long, alt string") -> DataFrame:
    """A streaming DataFrame (pipeline, sample, calls) over parquet files of calls in a folder."""
    return spark.readStream.schema(schema).parquet(folder).groupBy("pipeline", "sample").agg(F.count(F.lit(1)).alias("calls"))
