"""Time grids over long tables (entity, position, value): blocks, windows, trims, differences, settling and protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import TINY, Temporal
from tidegrid.functions.expr import average_rank, js_divergence, log2_ratio, number, safe_corr, total
from tidegrid.operators.intervals import interval_join
from tidegrid.sources.shared import written


def sample_block(position: Column, size: int) -> Column:
    """Number of the tumbling block that a sample position falls into."""
    return F.floor(position / size).cast("long")


def time_block(ts: Column, seconds: float, origin: str) -> Column:
    """Number of the tumbling block since an origin that a timestamp falls into."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.floor(micros / int(seconds * 1_000_000)).cast("long")


def full_blocks(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Only the rows of blocks with ``size`` rows."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("__n") == size).drop("__n")


def block_rms(df: DataFrame, entity: str, block: str, value: str) -> DataFrame:
    return df.groupBy(entity, block).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def block_profile(df: DataFrame, entity: str, block: str, value: str, component: str, components: Sequence[str]) -> DataFrame:
    """RMS of each block and the share of its power in each component; equal shares where there is no power.

    One grouping with a conditional sum for each component, so that only sums are shuffled.
    """
    power = F.col(value) * F.col(value)
    sums = [F.coalesce(F.sum(F.when(F.col(component) == c, power)), F.lit(0.0)) for c in components]
    grouped = df.groupBy(entity, block).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(power)).alias("rms"), F.array(*sums).alias("power"))
    share = F.when(total(F.col("power")) > 0, F.transform("power", lambda x: F.try_divide(x, total(F.col("power"))))).otherwise(F.array(*[F.lit(1.0 / len(components))] * len(components)))
    return grouped.withColumn("prof", share).drop("power")


def terminal(blocks: DataFrame, entity: str, block: str, most: int) -> DataFrame:
    """The last k blocks of each entity, k = max(2, min(most, n // 2)); n_blocks and k are added."""
    whole = Window.partitionBy(entity)
    back = F.row_number().over(Window.partitionBy(entity).orderBy(F.col(block).desc()))
    k = F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n_blocks") / 2).cast("int")))
    ranked = blocks.withColumn("n_blocks", F.count(F.lit(1)).over(whole)).withColumn("k", k)
    return ranked.withColumn("__back", back).filter(F.col("__back") <= F.col("k")).drop("__back")


def median_profile(blocks: DataFrame, keys: Sequence[str], width: int, profile: str = "prof", out: str = "median_prof") -> DataFrame:
    """Element-wise median of a profile within each group."""
    parts = [F.median(F.get(profile, F.lit(i))) for i in range(width)]
    return blocks.groupBy(*keys).agg(F.array(*parts).alias(out))


def record_ends(blocks: DataFrame, entity: str, block: str, most: int, width: int = 0) -> DataFrame:
    """(entity, n_blocks, first_block, last_block, k, end_rms[, end_prof]): each record's extent, and the medians over its last k blocks.

    Only the last few blocks of each task and entity are shuffled, and one row of counts; the rest of the blocks stays where it is.
    """
    facts = blocks.groupBy(entity).agg(F.count(F.lit(1)).alias("n_blocks"), F.min(block).alias("first_block"), F.max(block).alias("last_block"))
    facts = facts.withColumn("k", F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n_blocks") / 2).cast("int"))))
    back = F.row_number().over(Window.partitionBy(entity).orderBy(F.col(block).desc()))
    last = blocks.select(entity, "rms", *(["prof"] if width else []), back.alias("__back")).filter(F.col("__back") <= max(most, 2))
    medians = [F.median("rms").alias("end_rms")]
    if width:
        medians.append(F.array(*(F.median(F.get("prof", F.lit(i))) for i in range(width))).alias("end_prof"))
    ends = last.join(facts, entity).filter(F.col("__back") <= F.col("k"))
    return ends.groupBy(entity, "n_blocks", "first_block", "last_block", "k").agg(*medians)


def cohort_reference(blocks: DataFrame, entity: str, block: str, cfg: Temporal, width: int, ends: DataFrame | None = None) -> DataFrame:
    """One row: the element-wise median over entities of their terminal median profiles, scaled to sum 1 (equal shares if zero)."""
    ends = record_ends(blocks, entity, block, cfg.terminal_blocks, width) if ends is None else ends
    pooled = ends.filter("n_blocks >= 4").agg(F.array(*(F.median(F.get("end_prof", F.lit(i))) for i in range(width))).alias("raw"))
    even = F.array(*[F.lit(1.0 / width)] * width)
    return pooled.select(F.when(total(F.col("raw")) > 0, F.transform("raw", lambda x: F.try_divide(x, total(F.col("raw"))))).otherwise(even).alias("ref"))


def block_stability(blocks: DataFrame, entity: str, block: str, cfg: Temporal, width: int, use_profile: bool = True) -> DataFrame:
    """Each block with its deviations from the end of its record and from the reference profile, and whether it is stable.

    The ends of the records, a row for each, are found in one pass and written; the blocks are then shuffled once, to meet them. The
    cohort's reference, from the same ends, is a single row, broadcast. In self mode the reference is the median of the record's own last
    blocks.
    """
    ends = written(record_ends(blocks, entity, block, cfg.terminal_blocks, width if use_profile else 0), "record-ends")
    joined = blocks.join(ends.drop("first_block", "last_block"), entity)
    dev = F.abs(log2_ratio(F.col("rms"), F.col("end_rms")))
    stable = dev <= cfg.tol_log2
    if use_profile:
        if cfg.reference == "self":
            joined = joined.withColumn("ref", F.col("end_prof"))
        else:
            joined = joined.join(F.broadcast(cohort_reference(blocks, entity, block, cfg, width, ends)))
        joined = joined.withColumn("dev_js", js_divergence(F.col("prof"), F.col("ref"))).drop("ref", "end_prof")
        stable = stable & (F.col("dev_js") <= cfg.tol_js)
    return joined.withColumn("dev_log2", dev).withColumn("stable", stable)


def settling_time(stability: DataFrame, entity: str, block: str) -> DataFrame:
    """Start of each entity's longest all-stable run up to its last block; null when the last block is unstable."""
    bad = F.max(F.when(~F.col("stable"), F.col(block))).over(Window.partitionBy(entity))
    flagged = stability.withColumn("__bad", F.coalesce(bad, F.lit(-1)))
    grouped = flagged.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.min(block).alias("first_block"),
        F.max(block).alias("last_block"),
        F.avg(F.col("stable").cast("double")).alias("frac_stable"),
        F.min(F.when(F.col(block) > F.col("__bad"), F.col(block))).alias("first_stable"),
    )
    few = F.col("n_blocks") < 4
    status = F.when(few, "insufficient_blocks").when(F.col("first_stable").isNull(), "never_stable").otherwise("ok")
    return grouped.withColumn("status", status).withColumn("first_stable", F.when(~few, F.col("first_stable")))


def trend(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Spearman's correlation of y with x within each entity (average ranks, then Pearson)."""
    ranked = df.select(entity, average_rank(x, [entity]).alias("__x"), average_rank(y, [entity]).alias("__y"))
    return ranked.groupBy(entity).agg(safe_corr("__x", "__y").alias("rho"), F.count(F.lit(1)).alias("n"))


def protocol_subjects(settled: DataFrame, subject: str, duration: str, cfg: Temporal) -> DataFrame:
    """(subject, duration, eligible): whose recordings are long enough for the protocol, and whose are left out as too short."""
    least = cfg.fixed_skip + cfg.fixed_window if cfg.mode == "fixed" else cfg.min_seconds
    return settled.select(subject, duration, F.coalesce(F.col(duration) >= least, F.lit(False)).alias("eligible"))


def settling_figures(settled: DataFrame, settling: str, duration: str, spans: str, cfg: Temporal) -> DataFrame:
    """One row on the eligible records of a derived protocol: median and maximum of their settling, and how many drift over the whole record.

    A fixed protocol looks at no settling: the first two are null and the count is 0.
    """
    if cfg.mode == "fixed":
        return settled.agg(F.lit(None).cast("double").alias("settle_median"), F.lit(None).cast("double").alias("settle_max"), F.lit(0).cast("bigint").alias("n_drift_spans_record"))
    eligible = settled.filter(F.col(duration) >= cfg.min_seconds)
    return eligible.agg(F.median(number(F.col(settling))).alias("settle_median"), F.max(number(F.col(settling))).alias("settle_max"), F.count_if(F.coalesce(F.col(spans), F.lit(False))).alias("n_drift_spans_record"))


def temporal_protocol(settled: DataFrame, settling: str, duration: str, cfg: Temporal) -> DataFrame:
    """One row: the skip and the analysis windows that follow from the whole cohort, or the fixed window's."""
    if cfg.mode == "fixed":
        long_enough = F.col(duration) >= cfg.fixed_skip + cfg.fixed_window
        skip, window = F.lit(cfg.fixed_skip), F.lit(cfg.fixed_window)
        facts = settled.agg(F.count_if(long_enough).alias("n_eligible"), F.count_if(~long_enough).alias("n_short"), F.min(F.when(long_enough, F.col(duration))).alias("shortest"))
        return facts.select("n_eligible", "n_short", F.lit(None).cast("double").alias("settle_q"), "shortest", skip.alias("skip_raw"), skip.alias("skip"), (F.col("shortest") - skip).alias("available"), window.alias("window"), F.lit(1).alias("n_windows"), F.array(skip).alias("starts"), F.lit(False).alias("window_capped"), F.lit(False).alias("skip_capped"), F.lit(True).alias("protocol_valid"))
    eligible = F.col(duration) >= cfg.min_seconds
    facts = settled.agg(
        F.count_if(eligible).alias("n_eligible"),
        F.count_if(~eligible).alias("n_short"),
        F.percentile(F.when(eligible, F.col(settling)), F.lit(cfg.quantile)).alias("settle_q"),
        F.min(F.when(eligible, F.col(duration))).alias("shortest"),
    )
    raw = F.ceil(F.coalesce("settle_q", F.lit(cfg.min_skip)) / cfg.block_seconds) * cfg.block_seconds
    out = facts.withColumn("skip_raw", raw.cast("double")).withColumn("skip", F.least(F.greatest("skip_raw", F.lit(cfg.min_skip)), F.lit(cfg.max_skip)))
    out = out.withColumn("available", F.col("shortest") - F.col("skip"))
    out = out.withColumn("window", F.floor(F.least("available", F.lit(cfg.target), F.lit(cfg.max_window))).cast("double"))
    out = out.withColumn("n_windows", F.least(F.greatest(F.floor(F.try_divide("available", "window")).cast("int"), F.lit(1)), F.lit(cfg.n_windows)))
    gap = F.try_divide(F.col("available") - F.col("window"), F.col("n_windows") - 1)
    spread = F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda i: F.floor(F.col("skip") + F.coalesce(gap, F.lit(0.0)) * i).cast("double"))

    def push(starts: Column, start: Column) -> Column:
        return F.array_append(starts, F.greatest(start, F.coalesce(F.get(starts, F.size(starts) - 1) + F.col("window"), start)))

    starts = F.filter(F.aggregate(spread, F.array().cast("array<double>"), push), lambda s: s + F.col("window") <= F.col("shortest"))
    out = out.withColumn("starts", F.when(F.col("window") > 0, starts))
    out = out.withColumn("window_capped", F.col("available") < cfg.target)
    return out.withColumn("skip_capped", F.col("skip_raw") > cfg.max_skip).withColumn("protocol_valid", (F.col("window") > 0) & ~F.col("skip_capped"))


def cut_windows(samples: DataFrame, windows: DataFrame, t: str) -> DataFrame:
    """Samples with every window [start, start + length) that holds them; of any number, common to all subjects."""
    ends = windows.withColumn("__end", F.col("start") + F.col("length"))
    return interval_join(samples, ends, t, "start", "__end").drop("__end")


def edge_trim(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """Without the first and last k rows of each group; a group of 2k rows or fewer has none left."""
    window = Window.partitionBy(*keys)
    ranked = df.withColumn("__i", F.row_number().over(window.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(window))
    return ranked.filter((F.col("__i") > k) & (F.col("__i") <= F.col("__n") - k)).drop("__i", "__n")


def demean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, lag: int = 1) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(*order)))


def within_drift(blocks: DataFrame, entity: str, block: str, width: int) -> DataFrame:
    """Drift inside a window from its blocks: log2 of the RMS range, largest divergence to the own median, trend."""
    own = median_profile(blocks, [entity], width)
    scored = blocks.join(own, entity).withColumn("js", js_divergence(F.col("prof"), F.col("median_prof")))
    ranked = scored.withColumns({"__x": average_rank(block, [entity]), "__y": average_rank("rms", [entity])})
    return ranked.groupBy(entity).agg(
        F.log2((F.max("rms") + TINY) / (F.min("rms") + TINY)).alias("drift_log2_rms"),
        F.max("js").alias("drift_js"),
        safe_corr("__x", "__y").alias("drift_rms_spearman"),
    )


def nonstationarity(df: DataFrame, entity: str, block: str, channel: str, value: str) -> DataFrame:
    """Coefficient of variation over blocks of the variance, averaged over channels; null below three blocks."""
    variances = df.groupBy(entity, block, channel).agg(F.var_pop(value).alias("v"))
    blocks = variances.groupBy(entity, block).agg(F.avg("v").alias("v"))
    enough = (F.count(F.lit(1)) >= 3) & (F.avg("v") > 0)
    return blocks.groupBy(entity).agg(F.when(enough, F.stddev_pop("v") / F.avg("v")).alias("cv"), F.count(F.lit(1)).alias("n_blocks"))


def epochs_of(position: Column, length: int, overlap: float, n: Column) -> Column:
    """Numbers of the complete epochs (maybe overlapping) that hold a sample, as an array to explode."""
    step = max(1, round(length * (1 - overlap)))
    last = F.floor((n - length) / step)
    low = F.greatest(F.ceil((position - length + 1) / step), F.lit(0))
    high = F.least(F.floor(position / step), last)
    return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))
