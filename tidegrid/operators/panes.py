"""Overlapping epochs from panes.

Epochs of ``length`` samples that start every ``step`` samples are unions of panes as long as the common divisor of both. Samples are aggregated
once, into the states of panes (count, mean, sum of squared distances, smallest, largest), before the shuffle; an epoch is a moving
frame over its entity's panes, in which states are merged. What is shuffled doesn't grow with the overlap, and no sample is repeated.

Defined results: only complete epochs are returned; a null sample makes its epochs incomplete; samples at negative positions
belong to none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panes(df: DataFrame, keys: Sequence[str], position: str, value: str, size: int) -> DataFrame:
    """(keys, pane, n, mean, m2, low, high): the state of every pane of ``size`` positions."""
    v = F.col(value).cast("double")
    own = df.filter(F.col(position) >= 0).groupBy(*keys, F.floor(F.col(position) / size).alias("pane"))
    return own.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))


def epochs(df: DataFrame, keys: Sequence[str], position: str, value: str, length: int, step: int) -> DataFrame:
    """(keys, epoch, n, mean, rms, variance, ptp) of the complete epochs; epoch e holds the positions from e * step."""
    if length < 1 or step < 1:
        raise ValueError("length and step must be positive")
    size = math.gcd(length, step)
    frame = Window.partitionBy(*keys).orderBy("pane").rangeBetween(0, length // size - 1)
    # distances from the frame's first pane keep the digits that squares of large means would lose
    away = F.col("mean") - F.col("__near")
    placed = panes(df, keys, position, value, size).withColumn("__near", F.avg("mean").over(Window.partitionBy(*keys)))
    merged = placed.select(
        *keys,
        "pane",
        "__near",
        F.sum("n").over(frame).alias("n"),
        F.sum(F.col("n") * away).over(frame).alias("__s"),
        F.sum(F.col("m2") + F.col("n") * away * away).over(frame).alias("__q"),
        (F.max("high").over(frame) - F.min("low").over(frame)).alias("ptp"),
    )
    whole = merged.filter((F.col("n") == length) & (F.col("pane") * size % step == 0))
    mean = F.col("__s") / F.col("n")
    variance = F.greatest(F.col("__q") / F.col("n") - mean * mean, F.lit(0.0))
    level = mean + F.col("__near")
    return whole.select(*keys, (F.col("pane") * size / step).cast("long").alias("epoch"), "n", level.alias("mean"), F.sqrt(variance + level * level).alias("rms"), variance.alias("variance"), "ptp")
