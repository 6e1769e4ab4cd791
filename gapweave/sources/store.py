"""Tables that several parts of a plan read, written once into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place under ``spark.checkpoint.dir``, deleted when the driver ends; only a local session may lack that setting and
    gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        root = "file://" + tempfile.gettempdir()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = f"{root.rstrip('/')}/gapweave-tables/{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(conf)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{top}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` through Parquet: one plan writes it, each reader scans the columns it needs, and a lost executor costs no more
    than its tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
