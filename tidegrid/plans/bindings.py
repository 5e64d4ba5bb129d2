"""The public test tables seen as cohorts of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.timegrid import block_profile, time_block

ORIGIN = "2024-01-01 00:00:00"
COMPONENTS = ("view", "signup", "purchase", "error", "click")
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str, seconds: float = DAY) -> DataFrame:
    """events as samples: entity user_id, tumbling block of time, value; event_type is the channel."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "ts", "event_type", "value", time_block(F.col("ts"), seconds, ORIGIN).alias("block"))


def profiles(spark: SparkSession, sf_dir: str, seconds: float = DAY) -> DataFrame:
    return block_profile(activity(spark, sf_dir, seconds), "user_id", "block", "value", "event_type", COMPONENTS)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as epochs: subject is the label, epoch the vector, 64 samples each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with the documents' attributes as covariates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")
