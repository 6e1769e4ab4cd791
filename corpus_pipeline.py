"""From raw documents to token ids: the training-data pipeline.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and, but for the last,
returns the columns of ``documents``.  ``run`` writes each result as Parquet into the shared folder and
reads it as the next stage's input.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import bpe, decontaminate, langid, neardup, pii
from gapweave.llm.common import materialize, table

#: SQL can't express the learned and hashed stages; tests compare them with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays unclear (score under 0.5)."""
    return langid.keep_identified(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of texts that share 80 % of their five-word shingles."""
    return neardup.drop_near_duplicates(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a ten-word window (or a whole shorter item) of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks in the place of personal data; n_chars follows the text."""
    columns = docs.columns
    out = pii.redact_documents(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document."""

    def row(doc_id, ids, decoded):
        n = len(ids) // 4
        return doc_id, n, list(struct.unpack(f"<{n}I", ids)), decoded

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bpe.encode_rows(docs, row, f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
