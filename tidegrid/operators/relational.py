"""Joins and audits of a cohort with its metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_metadata(features: DataFrame, metadata: DataFrame, key: str, label: str) -> DataFrame:
    """Left join to a dimension; ``unmatched`` marks rows without a label."""
    return features.join(metadata, key, "left").withColumn("unmatched", F.col(label).isNull())


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join after a check that neither side repeats a key."""
    for side in (left, right):
        if not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} is repeated")
    return left.join(right, key, "left")


def cohort_audit(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """One row: how many expected ids were observed, which are missing or unexpected, and the coverage."""
    a = expected.select(key).distinct().withColumn("__e", F.lit(1))
    b = observed.select(key).distinct().withColumn("__o", F.lit(1))
    both = a.join(b, key, "full_outer")
    seen = F.count_if(F.col("__e").isNotNull() & F.col("__o").isNotNull())
    return both.agg(
        F.count("__e").alias("n_expected"),
        F.count("__o").alias("n_observed"),
        F.count_if(F.col("__o").isNull()).alias("n_missing"),
        F.count_if(F.col("__e").isNull()).alias("n_unexpected"),
        F.try_divide(seen.cast("double"), F.count("__e").cast("double")).alias("coverage"),
    )


def cohort_differences(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, status): the ids that are missing from the observed ones, and those that nobody expected. Null ids aren't compared."""
    a = expected.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__e", F.lit(1))
    b = observed.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__o", F.lit(1))
    status = F.when(F.col("__o").isNull(), "missing").when(F.col("__e").isNull(), "unexpected")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts by row and column value, zero where there is none."""
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """Names of a column family, sorted."""
    return sorted(c for c in df.columns if c.startswith(prefix))


def failures_by_stage(failures: DataFrame, stage: str, subject: str) -> DataFrame:
    return failures.groupBy(stage).agg(F.count(F.lit(1)).alias("n_failures"), F.count_distinct(subject).alias("n_subjects"))


def null_report(df: DataFrame) -> DataFrame:
    """(column, n_null): one pass over the table."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column", "n_null")
