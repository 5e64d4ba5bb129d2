"""Joins of samples with intervals of time, by buckets.

Intervals are cut at the edges of buckets of equal width, so that a long one becomes several short ones; a sample falls into one bucket.
The join is then one of equal keys and buckets, which Spark shuffles, splits or broadcasts by its own figures, and each pair is met
in one bucket only. The width is the mean length of the intervals unless it is given: then all cuts together are fewer than twice
the intervals, plus their number. No pair outside a bucket is looked at.

Defined results: intervals are [start, end); those with a null bound, or that end where they start or before, hold nothing; samples with a
null time or key meet nothing; overlapping intervals each get the sample; repeated intervals each keep their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(samples: DataFrame, intervals: DataFrame, t: str, start: str, end: str, by: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """All columns of samples and of intervals (``by`` once), for every sample inside an interval of the same ``by``."""
    by = list(by)
    held = intervals.withColumns({"__s": F.col(start).cast("double"), "__e": F.col(end).cast("double")}).filter("__s < __e")
    if width is None:
        width = held.agg(F.avg(F.col("__e") - F.col("__s")).alias("w")).first().w or 1.0
    first, last = F.floor(F.col("__s") / width), F.ceil(F.col("__e") / width) - 1
    cut = held.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(last, first))))
    placed = samples.withColumns({"__t": F.col(t).cast("double"), "__bucket": F.floor(F.col(t).cast("double") / width)})
    joined = placed.join(cut, [*by, "__bucket"])
    return joined.filter((F.col("__t") >= F.col("__s")) & (F.col("__t") < F.col("__e"))).drop("__bucket", "__t", "__s", "__e")
