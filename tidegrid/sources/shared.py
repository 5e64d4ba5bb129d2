"""Tables that more than one job reads, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is named and all runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.tidegrid.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="spark-tidegrid-")
        spark.conf.set("spark.tidegrid.scratch", own)
    return own


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once and read by every later use: what depends on places or partitions is the same for all of them."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
