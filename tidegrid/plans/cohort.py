"""The whole study: recordings and sheet in, protocol, quality, features, tests and reports out."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import PROFILE_BANDS, Settings, blocked_reasons
from tidegrid.operators import learn, quality, recordings, relational, stats, timegrid
from tidegrid.operators.quality import Rule
from tidegrid.sources import metadata, signals, sinks

WIDTH = len(PROFILE_BANDS)


def rules_of(cfg: Settings) -> list[Rule]:
    q = cfg.quality
    rules = [
        Rule("line_ratio_post", q.line),
        Rule("ocular_index", q.ocular),
        Rule("muscle_ratio", q.muscle),
        Rule("nonstationarity_cv", q.nonstationarity),
        Rule("zero_diff_fraction", q.frozen),
        Rule("saturation_fraction", q.saturation),
        Rule("min_channel_corr", q.min_corr, above=False),
    ]
    return [r for r in rules if q.use_nonstationarity or r.metric != "nonstationarity_cv"]


def settle(analysed: DataFrame, cfg: Settings) -> DataFrame:
    """Settling of every recording against the cohort's reference, in seconds."""
    blocks = analysed.select("subject_id", F.explode("blocks").alias("b")).select("subject_id", "b.*")
    stable = timegrid.block_stability(blocks, "subject_id", "block", cfg.temporal, WIDTH)
    found = timegrid.settling_time(stable, "subject_id", "block")
    trend = timegrid.trend(blocks, "subject_id", "block", "rms").select("subject_id", F.col("rho").alias("rms_trend_spearman"))
    tail = timegrid.trend(timegrid.terminal(blocks, "subject_id", "block", cfg.temporal.terminal_blocks), "subject_id", "block", "rms")
    tail = tail.select("subject_id", F.when(F.col("n") >= 3, F.col("rho")).alias("tail_rms_trend_spearman"))
    first = stable.filter("block = 0").select("subject_id", F.col("dev_log2").alias("dev_log2_first_block"), F.col("dev_js").alias("dev_js_first_block"))
    settled = found.join(trend, "subject_id").join(tail, "subject_id").join(first, "subject_id", "left").join(analysed.select("subject_id", "duration_s"), "subject_id")
    settled = settled.withColumn("drift_spans_record", F.coalesce(F.abs("tail_rms_trend_spearman") >= 0.5, F.lit(False)))
    return settled.withColumn("settling_time_s", F.col("first_stable") * cfg.temporal.block_seconds)


def windows_of(protocol: DataFrame) -> list[tuple[str, float, float]]:
    row = protocol.first()
    if not row.n_eligible or not row.starts:
        raise ValueError("no recording is long enough for an analysis window")
    return [(f"w{i + 1}", start, row.window) for i, start in enumerate(row.starts)]


def run(spark: SparkSession, signal_dir: str, sheet: str, out: str, cfg: Settings | None = None) -> dict:
    """Write all tables under ``out`` and return the summary."""
    cfg = cfg or Settings()
    recs = signals.read_recordings(spark, signal_dir, cfg.acquisition)
    recordings.analyse(recs, cfg).write.mode("overwrite").parquet(f"{out}/analysed")
    analysed = spark.read.parquet(f"{out}/analysed")
    duplicates = [r.subject_id for r in analysed.groupBy("subject_id").count().filter("count > 1").take(5)]
    if duplicates:
        raise ValueError(f"subjects with more than one recording: {duplicates}")
    good = analysed.filter("error is null")
    people = metadata.normalise(metadata.read_sheet(spark, sheet))

    sinks.write_table(settle(good, cfg), out, "temporal_settling")
    settled = spark.read.parquet(f"{out}/temporal_settling")
    protocol = timegrid.temporal_protocol(settled, "settling_time_s", "duration_s", cfg.temporal)
    figures = timegrid.settling_figures(settled, "settling_time_s", "duration_s", "drift_spans_record", cfg.temporal)
    sinks.write_table(protocol.join(F.broadcast(figures)), out, "protocol")  # one row each
    sinks.write_table(timegrid.protocol_subjects(settled, "subject_id", "duration_s", cfg.temporal), out, "protocol_subjects")
    windows = windows_of(spark.read.parquet(f"{out}/protocol"))

    metrics = good.select("subject_id", "source_name", "task", "n_samples", "duration_s", *(c.split()[0] for c in recordings.QC.split(", ")))
    outliers = cfg.quality.cohort_metrics
    judged = quality.decide(quality.with_mad_z(metrics, outliers), rules_of(cfg), outliers, cfg.quality.mad_z)
    sinks.write_table(judged, out, "subject_qc")
    judged = spark.read.parquet(f"{out}/subject_qc")
    sinks.write_table(quality.distribution(judged, rules_of(cfg), outliers, cfg.quality.mad_z), out, "qc_distribution")
    sinks.write_table(good.select("subject_id", *(c.split()[0] for c in recordings.FS_CHECK.split(", "))), out, "sampling_rate_verification")

    eligible = good.filter(F.col("duration_s") >= cfg.temporal.min_seconds)
    recordings.features(eligible, windows, cfg).write.mode("overwrite").parquet(f"{out}/features_all")
    every = spark.read.parquet(f"{out}/features_all")
    primary = every.filter("window_key = 'w1' and error is null")
    merged = relational.attach_metadata(primary.drop("error"), people, "subject_id", "label").join(judged.select("subject_id", "qc_pass", "qc_reasons"), "subject_id", "left")
    merged = merged.withColumn("drift_pass", quality.drift_pass(F.col("drift_log2_rms"), F.col("drift_js")))
    sinks.write_table(merged, out, "features_primary_window")
    merged = spark.read.parquet(f"{out}/features_primary_window")

    stage = lambda df, name: df.select("subject_id", F.lit(name).alias("stage"), "error")
    sinks.write_table(signals.discover(spark, signal_dir).select("source_name", "subject_id", "task", "status", "sha256"), out, "input_files")
    files = spark.read.parquet(f"{out}/input_files")
    quarantined = files.filter("status = 'quarantined'").select(F.col("source_name").alias("subject_id"), F.lit("filename").alias("stage"), F.lit("name not accepted").alias("error"))
    failures = quarantined.unionByName(stage(analysed.filter("error is not null"), "read_or_profile")).unionByName(every.filter("error is not null").select("subject_id", F.concat(F.lit("features_"), "window_key").alias("stage"), "error"))
    sinks.write_table(failures, out, "failures")
    failures = spark.read.parquet(f"{out}/failures")

    analytic = merged.filter("qc_pass and drift_pass and label is not null")
    counts = {r.label: r["count"] for r in analytic.groupBy("label").count().collect()}
    n = sum(counts.values())
    blocked = blocked_reasons(n, len(counts), min(counts.values(), default=0), cfg.mode, cfg.inference.min_subjects)
    expected = spark.createDataFrame([(i,) for i in cfg.expected_ids], "subject_id string") if cfg.expected_ids else people
    audit = relational.cohort_audit(expected, analysed, "subject_id").first().asDict() | {"expected_declared": bool(cfg.expected_ids)}
    sinks.write_table(relational.cohort_differences(expected, analysed, "subject_id"), out, "cohort_differences")
    summary = {
        "settings": cfg.fingerprint(),
        "n_recordings": analysed.count(),
        "n_excluded_short": good.filter(F.col("duration_s") < cfg.temporal.min_seconds).count(),
        "n_with_features": merged.count(),
        "n_unmatched": merged.filter("unmatched").count(),
        "n_analytic": n,
        "labels": counts,
        "audit": audit,
        "failures": {r.stage: r.n_failures for r in relational.failures_by_stage(failures, "stage", "subject_id").collect()},
        "windows": windows,
        "blocked": blocked,
    }
    if not blocked:
        others = every.filter("error is null").drop("error").join(analytic.select("subject_id", "label"), "subject_id")
        summary["analysis"] = analyse_groups(analytic, others, out, cfg)
    sinks.write_json(spark, summary, out, "run_summary")
    # one digest of all inputs, whatever their order: the sum of 60 bits of each file's name and content
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", "source_name", "sha256"), 256), 1, 15), 16, 10)
    digest = str(files.agg(F.sum(bits.cast("decimal(38,0)")).alias("d")).first().d)
    sinks.write_json(spark, sinks.manifest(cfg.fingerprint()) | {"inputs": digest}, out, "manifest")
    return summary


def out_of_fold(df: DataFrame, columns: list[str], cfg: Settings, out: str, name: str, guard: bool = True) -> dict:
    """Nested cross-validation over a set of columns: metrics, AUC and its interval over subjects."""
    sinks.write_table(learn.nested_cv(df, "subject_id", columns, "label", cfg.inference, guard=guard), out, f"out_of_fold_by_repeat_{name}", csv=False)
    oof = df.sparkSession.read.parquet(f"{out}/out_of_fold_by_repeat_{name}")
    sinks.write_table(learn.mean_probabilities(oof, "subject_id"), out, f"out_of_fold_{name}", csv=False)
    probs = df.sparkSession.read.parquet(f"{out}/out_of_fold_{name}")
    metrics = stats.threshold_metrics(probs, "label", "prob", cfg.inference.threshold).first().asDict()
    metrics["roc_auc"] = stats.mann_whitney(probs, ["perm"], "prob", "label").first().auc
    metrics["pr_auc"] = stats.average_precision(probs, ["perm"], "label", "prob").first().average_precision
    boot = stats.bootstrap_auc(probs, "subject_id", "label", "prob", cfg.inference.n_boot)
    both = stats.bootstrap_auc_repeats(oof, "subject_id", "repeat", "label", "prob", cfg.inference.n_boot)
    metrics["roc_auc_ci95_subjects_and_repeats"] = both.agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    metrics["roc_auc_ci95"] = boot.agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    return metrics


def analyse_groups(analytic: DataFrame, by_window: DataFrame, out: str, cfg: Settings) -> dict:
    """Group tests, adjusted models, nested cross-validation with baselines, its permutation test, and the other windows."""
    columns = relational.prefixed(analytic, "p__")
    long = stats.long_features(analytic, ["subject_id", "label"], columns)
    tests = stats.group_tests(long, "value", "label", cfg.inference.fdr)
    intervals = stats.bootstrap_g(long, "subject_id", "value", "label", cfg.inference.n_boot)
    sinks.write_table(tests.join(intervals, "feature", "left"), out, "confirmatory_tests")
    covariates = [c for c in ("age", "sex", "education_years") if c in analytic.columns]
    adjusted = long.join(analytic.select("subject_id", *covariates), "subject_id")
    sinks.write_table(learn.adjusted_logit(adjusted, "label", covariates), out, "confound_adjusted_models")
    found = {"metrics": out_of_fold(analytic, columns, cfg, out, "primary"), "baselines": {"majority": {"roc_auc": 0.5, "balanced_accuracy": 0.5}}}
    if covariates:
        found["baselines"]["demographic"] = out_of_fold(analytic, covariates, cfg, out, "demographic", guard=False)
        found["baselines"]["combined"] = out_of_fold(analytic, [*columns, *covariates], cfg, out, "combined", guard=False)
    matched = learn.nested_cv(analytic, "subject_id", columns, "label", cfg.inference, cfg.inference.matched_repeats, cfg.inference.n_permutations)
    aucs = stats.mann_whitney(learn.mean_probabilities(matched, "subject_id"), ["perm"], "prob", "label")
    found["permutation"] = learn.permutation_test(aucs).first().asDict()
    found["batch"] = stats.batch_confound(analytic, "id_prefix", "label").first().asDict()
    windows = stats.long_features(by_window, ["subject_id", "label", "window_key"], columns)
    effects = windows.groupBy("window_key", "feature").agg(stats.hedges_g("value", "label").alias("g"))
    sinks.write_table(effects, out, "effects_by_window")
    effects = analytic.sparkSession.read.parquet(f"{out}/effects_by_window")
    primary = effects.filter("window_key = 'w1'").select("feature", F.col("g").alias("primary"))
    keys = sorted(r.window_key for r in effects.select("window_key").distinct().collect())
    found["concordance"] = {k: stats.sign_agreement(effects.filter(F.col("window_key") == k).join(primary, "feature"), "primary", "g", "feature", cfg.inference.n_boot).first().asDict() for k in keys if k != "w1"}
    return found


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Analyse a cohort of recordings")
    parser.add_argument("--signals", required=True)
    parser.add_argument("--metadata", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--selection-criterion", required=True)
    parser.add_argument("--mode", choices=("integration", "research"), default="integration")
    parser.add_argument("--temporal-mode", choices=("derived", "fixed"), default="derived")
    args = parser.parse_args(argv)
    if len(args.selection_criterion) < 10:
        parser.error("the selection criterion must be stated in ten characters or more")
    base = Settings()
    cfg = dataclasses.replace(base, mode=args.mode, temporal=dataclasses.replace(base.temporal, mode=args.temporal_mode))
    print(sinks.as_json(run(SparkSession.builder.getOrCreate(), args.signals, args.metadata, args.output, cfg)))


if __name__ == "__main__":
    main()
