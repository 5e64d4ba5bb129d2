import dataclasses
import json
import os

import numpy as np
import pytest

from tidegrid.config import Inference, Quality, Settings, Temporal
from tidegrid.operators import learn, timegrid
from tidegrid.plans import cohort
from tidegrid.sources import metadata, signals

FS = 250.0


def write_signal(path, data):
    np.savetxt(path, data.T.astype(np.int64), fmt="%d")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    (root / "signals").mkdir()
    for k in range(4):
        data = signals.synthetic(FS, 700, 10.0, 40 + 30 * k, k)
        data[0, :3] -= 5000  # negative at first, stored as unsigned below
        write_signal(root / f"signals/0201000{k}_still.txt", np.where(data < 0, data + 2**32, data))
    write_signal(root / "signals/02010009.txt", signals.synthetic(FS, 72.8, seed=9))
    (root / "signals/wrong name.txt").write_text("1 2 3\n")
    (root / "signals/02010010_still.txt").write_text("1 2\n3 4\n")
    (root / "signals/02010011_still.txt").write_text("1 2 3.5\n")
    (root / "signals/02010012_dancing.txt").write_text("1 2 3\n")
    (root / "meta.csv").write_text("Subject ID,type,Age,gender,education（years）,Unnamed: 5\n2010000.0,MDD,30,M,12,\n2010001,HC,31,F,13,\n2010002,mdd x,32,1,14,\n2010003,HC2,33,2,15,\n2010009,HC,34,2,16,\n2010077,HC,35,1,17,\n")
    return root


def test_contract_errors_are_rows(spark, folder):
    got = {r.source_name: r for r in signals.read_recordings(spark, str(folder / "signals"), Settings().acquisition).drop("data").collect()}
    assert len(got) == 8
    assert got["02010000_still.txt"].error is None and got["02010000_still.txt"].n_wraparound_fixed > 0 and got["02010000_still.txt"].n_samples == 175_000
    assert got["02010009.txt"].task == "unspecified"
    assert "columns" in got["02010010_still.txt"].error and "integers" in got["02010011_still.txt"].error and "dancing" in got["02010012_dancing.txt"].error
    assert signals.discover(spark, str(folder / "signals")).filter("status = 'quarantined'").count() == 1


def test_sheet(spark, folder):
    rows = {r.subject_id: r for r in metadata.normalise(metadata.read_sheet(spark, str(folder / "meta.csv"))).collect()}
    assert set(rows) == {"02010000", "02010001", "02010002", "02010003", "02010009", "02010077"}
    assert rows["02010000"].label == 1 and rows["02010003"].label == 0 and rows["02010000"].sex == 1.0 and rows["02010001"].sex == 0.0
    assert rows["02010002"].sex == 1.0 and rows["02010003"].sex == 0.0 and rows["02010003"].education_years == 15.0 and rows["02010001"].id_prefix == "0201"
    doubled = spark.createDataFrame([("1", "HC"), ("1.0", "HC")], "id string, type string")
    with pytest.raises(ValueError):
        metadata.normalise(doubled)


def test_whole_study(spark, folder, tmp_path):
    cfg = Settings(temporal=Temporal(min_seconds=600))
    summary = cohort.run(spark, str(folder / "signals"), str(folder / "meta.csv"), str(tmp_path), cfg)
    assert summary["n_excluded_short"] == 1 and summary["n_with_features"] == 4 and summary["n_unmatched"] == 0
    assert "integration mode" in summary["blocked"] and summary["failures"]["filename"] == 1 and summary["failures"]["read_or_profile"] == 3
    assert summary["audit"]["n_missing"] == 1 and not summary["audit"]["expected_declared"]
    assert {(r.subject_id, r.status) for r in spark.read.parquet(f"{tmp_path}/cohort_differences").filter("status = 'missing'").collect()} == {("02010077", "missing")}
    assert {len(r.sha256) for r in spark.read.parquet(f"{tmp_path}/input_files").collect()} == {64}
    protocol = spark.read.parquet(f"{tmp_path}/protocol").first()
    assert protocol.n_drift_spans_record >= 0 and protocol.settle_max >= protocol.settle_median
    assert spark.read.parquet(f"{tmp_path}/protocol_subjects").filter("not eligible").count() == 1
    starts = [s for _, s, _ in summary["windows"]]
    lengths = [n for _, _, n in summary["windows"]]
    assert all(a + n <= b for a, n, b in zip(starts, lengths, starts[1:], strict=False)) and starts[0] >= 30
    for name in ("failures", "features_primary_window", "subject_qc", "qc_distribution", "temporal_settling", "protocol", "protocol_subjects", "input_files", "cohort_differences", "sampling_rate_verification"):
        assert spark.read.parquet(f"{tmp_path}/{name}").columns and os.listdir(f"{tmp_path}/{name}_csv")
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/run_summary").collect()))["n_recordings"] == 8
    alpha = spark.read.parquet(f"{tmp_path}/features_primary_window").select("p__alpha_peak_hz").collect()
    assert all(abs(r[0] - 10) < 1 for r in alpha)


def test_protocol_caps_and_short_records(spark):
    rows = [("a", 700.0, 1000.0), ("b", 600.0, 900.0), ("c", None, 100.0)]
    got = timegrid.temporal_protocol(spark.createDataFrame(rows, "s string, settling double, duration double"), "settling", "duration", Temporal()).first()
    assert got.skip == 420 and got.skip_capped and not got.protocol_valid and got.n_short == 1 and got.window == 240 and got.starts == [420.0, 660.0]
    none = timegrid.temporal_protocol(spark.createDataFrame(rows[2:], "s string, settling double, duration double"), "settling", "duration", Temporal()).first()
    assert none.n_eligible == 0 and not none.starts


def test_learning_finds_a_signal_and_permutations_do_not(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, float(rng.normal(2.0 * (i % 2))), float(rng.normal()) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label int, p__a double, p__b double")
    cfg = Inference(outer_folds=4, inner_folds=3, grid=(0.1, 1.0))
    oof = learn.nested_cv(df, "id", ["p__a", "p__b"], "label", cfg, repeats=2, permutations=10).toPandas()
    assert oof.groupby(["perm", "repeat"]).id.nunique().eq(80).all()
    means = oof.groupby(["perm", "id"]).agg(label=("label", "first"), prob=("prob", "mean")).reset_index()
    aucs = {p: learn.auc(g.label.to_numpy(), g.prob.to_numpy()) for p, g in means.groupby("perm")}
    assert aucs[0] > 0.8 and np.mean([a for p, a in aucs.items() if p]) < 0.65
    with pytest.raises(ValueError):
        learn.nested_cv(df, "id", ["label"], "label", cfg)


def test_adjusted_model_reports_errors_by_feature(spark):
    rng = np.random.default_rng(6)
    rows = [(f, float(rng.normal(i % 2)), i % 2, float(rng.normal())) for f, n in (("p__a", 60), ("p__few", 5)) for i in range(n)]
    got = {r.feature: r for r in learn.adjusted_logit(spark.createDataFrame(rows, "feature string, value double, label int, age double"), "label", ["age"]).collect()}
    assert got["p__a"].odds_ratio > 1 and got["p__a"].ci_low < got["p__a"].odds_ratio < got["p__a"].ci_high and 0 <= got["p__a"].p_fdr <= 1
    assert got["p__few"].error == "too few subjects" and got["p__few"].p is None


def test_research_mode_needs_frozen_thresholds():
    ready = Settings(mode="research", quality=Quality(frozen_thresholds=True))
    assert dataclasses.replace(ready, mode="integration").mode == "integration"


def test_streamed_blocks_equal_batch_blocks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidegrid.streaming.blocks import streaming_block_rms

    path = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are absent")
    events = spark.read.parquet(path)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming_block_rms(stream, "user_id", "ts", "value").writeStream.format("memory").queryName("block_rms").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    streamed = {(r.user_id, r.block_start): (r.n, round(r.rms, 6)) for r in spark.table("block_rms").collect()}
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    batch = events.groupBy("user_id", day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).collect()
    assert streamed == {(r.user_id, r.d): (r.n, round(r.rms, 6)) for r in batch}


def test_research_mode_analyses_every_window(spark, tmp_path):
    from tidegrid.config import PRIMARY_FEATURES

    rng = np.random.default_rng(11)
    rows = []
    for i in range(48):
        for w in ("w1", "w2"):
            rows.append((f"{i % 3:04d}{i:04d}", w, i % 2, 30.0 + i % 7, *(float(rng.normal(i % 2)) for _ in PRIMARY_FEATURES)))
    names = [f"p__{f}" for f in PRIMARY_FEATURES]
    every = spark.createDataFrame(rows, f"subject_id string, window_key string, label int, age double, {', '.join(n + ' double' for n in names)}")
    analytic = every.filter("window_key = 'w1'").selectExpr("*", "substr(subject_id, 1, 4) as id_prefix")
    cfg = Settings(inference=Inference(outer_folds=3, outer_repeats=2, inner_folds=2, grid=(0.1,), n_permutations=6, matched_repeats=1, n_boot=50))
    found = cohort.analyse_groups(analytic, every, str(tmp_path), cfg)
    low, high = found["metrics"]["roc_auc_ci95"]
    assert 0.8 < found["metrics"]["roc_auc"] <= 1 and low <= found["metrics"]["roc_auc"] <= high
    assert found["metrics"]["roc_auc"] > found["baselines"]["demographic"]["roc_auc"] and found["permutation"]["p_value"] < 0.3
    assert found["concordance"]["w2"]["n_features"] == 9 and not found["batch"]["flagged"]


def test_fixed_windows_and_own_reference(spark):
    fixed = Temporal(mode="fixed", fixed_skip=60, fixed_window=240)
    got = timegrid.temporal_protocol(spark.createDataFrame([("a", 1.0, 400.0), ("b", 1.0, 200.0)], "s string, settling double, duration double"), "settling", "duration", fixed).first()
    assert got.n_eligible == 1 and got.n_short == 1 and got.starts == [60.0] and got.window == 240
    blocks = [(s, b, 10.0, 1.0, [0.7, 0.3] if (s == "a") == (b > 2) else [0.3, 0.7]) for s in "ab" for b in range(10)]
    df = spark.createDataFrame(blocks, "s string, block long, n double, rms double, prof array<double>")
    own = timegrid.settling_time(timegrid.block_stability(df, "s", "block", Temporal(reference="self", tol_js=0.05), 2), "s", "block")
    assert {r.s: r.first_stable for r in own.collect()} == {"a": 3, "b": 3}


def test_bootstrap_auc_is_centred_on_the_auc(spark):
    from tidegrid.operators import stats

    rng = np.random.default_rng(8)
    rows = [(i, i % 2, float(rng.normal(i % 2))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    aucs = [r.auc for r in stats.bootstrap_auc(df, "id", "label", "score", 60).collect()]
    long = df.selectExpr("id", "label", "score as value", "'f' as feature")
    g = long.groupBy("feature").agg(stats.hedges_g("value", "label").alias("g")).first().g
    ci = stats.bootstrap_g(long, "id", "value", "label", 60).first()
    assert ci.g_ci_low < g < ci.g_ci_high
    assert np.mean(aucs) == pytest.approx(learn.auc(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), abs=0.02)
