"""Epoch rejection and the aggregation of epoch features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import TINY, Epoching
from tidegrid.functions.expr import finite
from tidegrid.operators.complexity import diff

RULES = ("nonfinite", "flat", "p2p_high", "p2p_low", "jump", "ocular_lf")


def rejection(df: DataFrame, keys: list[str], epoch: str, x: str, low_share: str, cfg: Epoching) -> DataFrame:
    """One row per epoch: which rules reject it and whether it is good.

    df has a row per (keys, epoch, channel). Ratios are to the median over the epochs of the same keys and channel.
    """
    shape = df.withColumns({"p2p": F.array_max(x) - F.array_min(x), "jump": F.array_max(F.transform(diff(F.col(x)), lambda d: F.abs(d))), "is_finite": F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False)))})
    own = Window.partitionBy(*keys, "channel")
    ratio = lambda c: F.col(c) / (F.median(c).over(own) + TINY)
    scored = shape.withColumns({"r_p2p": ratio("p2p"), "r_jump": ratio("jump"), "r_low": ratio(low_share)})
    broken = {
        "nonfinite": ~F.col("is_finite"),
        "flat": ~(F.col("p2p") > 0),
        "p2p_high": F.col("r_p2p") > cfg.p2p[1],
        "p2p_low": F.col("r_p2p") < cfg.p2p[0],
        "jump": F.col("r_jump") > cfg.jump,
        "ocular_lf": F.col("r_low") > cfg.low_share,
    }
    by = scored.groupBy(*keys, epoch).agg(*(F.bool_or(F.coalesce(c, F.lit(True))).alias(f"rej_{n}") for n, c in broken.items()))
    good = ~F.lit(False)
    for n in RULES:
        good = good & ~F.col(f"rej_{n}")
    return by.withColumn("good", good)


def rejection_summary(masked: DataFrame, keys: list[str]) -> DataFrame:
    counts = [F.count_if(f"rej_{n}").alias(f"n_rej_{n}") for n in RULES]
    return masked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_epochs"), F.count_if("good").alias("n_good"), F.avg((~F.col("good")).cast("double")).alias("frac_rejected"), *counts)


def aggregate_epochs(df: DataFrame, keys: list[str], epoch: str, features: list[str], how: str = "median") -> DataFrame:
    """p__ columns: median over channels, then median or mean over epochs; e__iqr_ columns: spread over epochs."""
    over_channels = df.groupBy(*keys, epoch).agg(*(F.median(f).alias(f) for f in features))
    pick = F.median if how == "median" else F.avg
    quart = lambda f: F.percentile(f, F.lit(0.75)) - F.percentile(f, F.lit(0.25))
    return over_channels.groupBy(*keys).agg(*(pick(f).alias(f"p__{f}") for f in features), *(quart(f).alias(f"e__iqr_{f}") for f in features), F.count(F.lit(1)).alias("n_epochs"))


def asymmetry(df: DataFrame, keys: list[str], epoch: str, channel: str, power: str, left, right, how: str = "median") -> DataFrame:
    """(keys, n_epochs, asymmetry): median or mean over epochs of the log of the right channel's power less that of the left one.

    An epoch that lacks one of the channels doesn't count; of several rows of a channel the largest power is taken.
    """
    side = lambda c: F.ln(F.max(F.when(F.col(channel) == c, F.col(power))) + TINY)
    by = df.groupBy(*keys, epoch).agg((side(right) - side(left)).alias("__a"))
    pick = F.median if how == "median" else F.avg
    return by.groupBy(*keys).agg(F.count("__a").alias("n_epochs"), pick("__a").alias("asymmetry"))
