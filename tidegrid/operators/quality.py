"""Quality control of records: metrics, robust outliers, decisions with reasons, reports and audits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import TINY
from tidegrid.functions.expr import finite, joined_reasons, number


@dataclass(frozen=True)
class Rule:
    """A metric's threshold: the record fails where the metric is beyond it."""

    metric: str
    threshold: float
    above: bool = True
    name: str = ""

    def fails(self) -> Column:
        value = F.col(self.metric)
        return finite(value) & ((value > self.threshold) if self.above else (value < self.threshold))

    def reason(self) -> str:
        return self.name or f"{self.metric} {'>' if self.above else '<'} {self.threshold:g}"


def record_metrics(df: DataFrame, entity: str, order: Sequence[str], value: str, low: float, high: float, fs: float = 1.0) -> DataFrame:
    """Sample-level metrics of each record in one grouping: size, finiteness, saturation, frozen steps and amplitude."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(entity).orderBy(*order))
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)))
    return df.withColumn("__step", step).groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_samples"),
        (F.count(F.lit(1)) / fs).alias("duration_s"),
        F.bool_and(F.coalesce(finite(F.col(value)), F.lit(False))).alias("finite"),
        (F.max(value) - F.min(value) == 0).cast("int").alias("flat_channels"),
        F.avg(((F.col(value) <= low) | (F.col(value) >= high)).cast("double")).alias("saturation_fraction"),
        F.avg(F.when(F.col("__step").isNotNull(), (F.col("__step") == 0).cast("double"))).alias("zero_diff_fraction"),
        rms.alias("rms"),
        F.log10(rms + TINY).alias("log_rms"),
    )


def with_mad_z(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Adds z__<metric>: distance from the cohort's median in units of 1.4826 MAD, or of the deviation where MAD is 0.

    Two one-row aggregates over the cohort's table, one after the other, each broadcast back.
    """
    medians = df.agg(*(F.median(number(F.col(m))).alias(f"__med_{m}") for m in metrics))
    centred = df.join(F.broadcast(medians))
    spreads = centred.agg(*(F.median(F.abs(number(F.col(m)) - F.col(f"__med_{m}"))).alias(f"__mad_{m}") for m in metrics), *(F.stddev_pop(number(F.col(m))).alias(f"__sd_{m}") for m in metrics))
    out = centred.join(F.broadcast(spreads))
    for m in metrics:
        unit = F.when(F.col(f"__mad_{m}") > 0, 1.4826 * F.col(f"__mad_{m}")).otherwise(F.col(f"__sd_{m}"))
        out = out.withColumn(f"z__{m}", F.try_divide(number(F.col(m)) - F.col(f"__med_{m}"), F.nullif(unit, F.lit(0.0))))
    return out.drop(*(f"__{kind}_{m}" for kind in ("med", "mad", "sd") for m in metrics))


def decide(df: DataFrame, rules: Sequence[Rule], outliers: Sequence[str], z: float) -> DataFrame:
    """Adds qc_reasons and qc_pass: absolute rules in order, then flat channels, then the cohort's outliers."""
    pairs = [(r.reason(), r.fails()) for r in rules]
    if "flat_channels" in df.columns:
        pairs.append(("flat channel", F.col("flat_channels") > 0))
    pairs += [(f"outlier {m}", F.abs(F.col(f"z__{m}")) > z) for m in outliers]
    return df.withColumn("qc_reasons", joined_reasons(pairs)).withColumn("qc_pass", F.col("qc_reasons") == "")


def distribution(df: DataFrame, rules: Sequence[Rule], outliers: Sequence[str], z: float) -> DataFrame:
    """For each metric its spread and how many records its threshold excludes."""
    every = [*rules, *(Rule(f"z__{m}", z, name="abs") for m in outliers)]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(r.metric).alias("metric"), F.lit(float(r.threshold)).alias("threshold"), F.lit("abs_greater" if r.name == "abs" else "greater" if r.above else "less").alias("direction"), number(F.col(r.metric)).alias("v")) for r in every))).alias("x")).select("x.*")
    beyond = F.when(F.col("direction") == "less", F.col("v") < F.col("threshold")).when(F.col("direction") == "greater", F.col("v") > F.col("threshold")).otherwise(F.abs("v") > F.col("threshold"))
    marks = dict(p05=0.05, q25=0.25, median=0.5, q75=0.75, p95=0.95)
    return long.groupBy("metric", "threshold", "direction").agg(
        F.count("v").alias("n_valid"),
        F.min("v").alias("min"),
        *(F.percentile("v", F.lit(q)).alias(n) for n, q in marks.items()),
        F.max("v").alias("max"),
        F.count_if(beyond).alias("n_excluded"),
        F.try_divide(F.count_if(beyond).cast("double"), F.count("v").cast("double")).alias("frac_excluded"),
    )


def redundancy_audit(df: DataFrame, reasons: str, passed: str, drift_ok: str, token: str) -> DataFrame:
    """Among records that pass on drift but fail quality: only for a reason with ``token``, for it and others, or for others."""
    parts = F.filter(F.transform(F.split(reasons, ";"), lambda r: F.trim(r)), lambda r: r != "")
    has, only = F.exists(parts, lambda r: r.contains(token)), F.forall(parts, lambda r: r.contains(token))
    kind = F.when(has & only, "only").when(has, "plus_others").otherwise("others")
    return df.filter(F.col(drift_ok) & ~F.col(passed)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def drift_pass(log2_rms: Column, js: Column, most_log2: float = 1.5, most_js: float = 0.35) -> Column:
    return F.coalesce((log2_rms <= most_log2) & (js <= most_js), F.lit(False))


INFINITE = math.inf
