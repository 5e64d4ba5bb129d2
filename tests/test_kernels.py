"""The numpy kernels that run on recordings agree with the Column versions that the queries check, and statistics with known values."""

import dataclasses
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.config import Acquisition, Epoching, Settings
from tidegrid.functions.expr import js_divergence, normal_two_sided
from tidegrid.operators import complexity, epochs, recordings, spectral, stats
from tidegrid.operators.filtering import share
from tidegrid.sources import metadata, signals

FS, N = 128.0, 128


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(3)
    t = np.arange(N) / FS
    return np.stack([np.sin(2 * np.pi * (8 + k % 5) * t + k) * (1 + k % 3) + rng.normal(size=N) for k in range(30)])


@pytest.fixture(scope="module")
def frame(spark, signal):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(signal)], "k long, x array<double>")


def collected(frame, column):
    return np.array([r.v if r.v is not None else math.nan for r in frame.select("k", column.alias("v")).orderBy("k").collect()], float)


def test_complexity(signal, frame):
    cfg = Settings(acquisition=Acquisition(fs=FS))
    own = recordings.epoch_features(signal[:, None, :], FS, cfg)
    hjorth = complexity.hjorth(F.col("x"))
    parts = hjorth if isinstance(hjorth, dict) else {"mobility": hjorth["mobility"], "complexity": hjorth["complexity"]}
    assert collected(frame, parts["mobility"]) == pytest.approx(own["hjorth_mobility"][:, 0], rel=1e-9)
    assert collected(frame, parts["complexity"]) == pytest.approx(own["hjorth_complexity"][:, 0], rel=1e-9)
    assert collected(frame, complexity.permutation_entropy(F.col("x"))) == pytest.approx(own["perm_entropy"][:, 0], rel=1e-9)
    with_power = frame.withColumn("p", spectral.power_spectrum("x"))
    assert collected(with_power, spectral.c0(F.col("p"), N)) == pytest.approx(own["c0_complexity"][:, 0], rel=1e-6)


def test_spectra_lines_and_divergence(signal, frame):
    step = FS / N
    with_power = frame.withColumn("p", spectral.power_spectrum("x"))
    p = np.abs(np.fft.rfft(signal, axis=1)) ** 2
    f = np.arange(N // 2 + 1) * step
    assert collected(with_power, spectral.band_share(F.col("p"), 8, 13, step)) == pytest.approx(share(f, p, 8, 13, (1.0, 40.0)), rel=1e-6)
    for mains in (50.0, 60.0, 55.0):
        hum = signal + 40 * np.sin(2 * np.pi * mains * np.arange(N) / FS)
        cfg = dataclasses.replace(Settings(acquisition=Acquisition(fs=FS)))
        rows = frame.sparkSession.createDataFrame([(k, row.tolist()) for k, row in enumerate(hum)], "k long, x array<double>").withColumn("p", spectral.power_spectrum("x"))
        found = rows.select("k", spectral.line_check(F.col("p"), step, cfg.acquisition).alias("c")).orderBy("k").select("c.*").collect()
        for r, own in zip(found, (recordings.line_peak(f, q, cfg) for q in np.abs(np.fft.rfft(hum, axis=1)) ** 2), strict=True):
            assert (r.peak_hz, r.status) == (own["peak_hz"], own["fs_status"]) and r.implied_fs == pytest.approx(own["implied_fs"]) and r.prominence == pytest.approx(own["prominence"])
            assert own["fs_supported"] == (mains != 55.0)
    # no line: the edges of the band decide
    noise = np.random.default_rng(9).normal(size=(60, N))
    rows = frame.sparkSession.createDataFrame([(k, row.tolist()) for k, row in enumerate(noise)], "k long, x array<double>").withColumn("p", spectral.power_spectrum("x"))
    found = rows.select("k", spectral.line_check(F.col("p"), step, cfg.acquisition).alias("c")).orderBy("k").select("c.*").collect()
    for r, own in zip(found, (recordings.line_peak(f, q, cfg) for q in np.abs(np.fft.rfft(noise, axis=1)) ** 2), strict=True):
        assert (r.peak_hz, r.status) == (own["peak_hz"], own["fs_status"]) and r.prominence == pytest.approx(own["prominence"])
    q = [0.1, 0.2, 0.3, 0.4, 0.0]
    rows = frame.sparkSession.createDataFrame([(k, np.random.default_rng(k).dirichlet(np.ones(5)).tolist()) for k in range(5)], "k long, d array<double>")
    own = [recordings._js(np.array(r.d), np.array(q)) for r in rows.orderBy("k").collect()]
    assert collected(rows, js_divergence(F.col("d"), F.array(*map(F.lit, q)))) == pytest.approx(own, rel=1e-9)


def test_epoch_rejection(spark, signal):
    x = signal.reshape(10, 3, N)
    x[2] *= 9
    cfg = Settings(epochs=Epoching(p2p=(0.5, 3.0), jump=3.0, low_share=2.0))
    lf = np.random.default_rng(0).uniform(0.1, 0.5, (10, 3))
    good, _ = recordings.good_epochs(x, lf, cfg)
    rows = [("s", e, c, x[e, c].tolist(), float(lf[e, c])) for e in range(10) for c in range(3)]
    parts = spark.createDataFrame(rows, "subject string, epoch long, channel long, x array<double>, lf double")
    got = epochs.rejection(parts, ["subject"], "epoch", "x", "lf", cfg.epochs).orderBy("epoch").collect()
    assert [r.good for r in got] == good.tolist() and not good[2]


def test_no_line_gives_no_rates():
    cfg = Settings()
    f = np.arange(0, 125, 0.125)
    found = recordings.line_peak(f, np.ones(len(f)), cfg)
    assert found["implied_fs"] == [] and found["fs_status"].startswith("no_line")


def test_known_p_values(spark):
    row = spark.range(1).select(
        stats.binomial_greater(F.lit(7), F.lit(9)).alias("b"),
        stats.binomial_greater(F.lit(5100), F.lit(10_000)).alias("large"),
        stats.binomial_greater(F.lit(50_600_000), F.lit(100_000_000)).alias("tail"),
        stats.fisher_exact(*map(F.lit, (3, 1, 1, 3))).alias("f"),
        stats.fisher_exact(*map(F.lit, (30_000, 20_000, 29_500, 20_500))).alias("wide"),
        normal_two_sided(F.lit(1.959963984540054)).alias("z"),
    ).first()
    assert row.b == pytest.approx(46 / 512, rel=1e-8)
    exact = sum(math.comb(10_000, i) for i in range(5100, 10_001)) / 2**10_000
    assert row.large == pytest.approx(exact, rel=1e-6) and 0 <= row.tail < 1e-12
    assert row.f == pytest.approx(34 / 70, rel=1e-8)
    log_c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    logs = [log_c(50_000, x) + log_c(50_000, 59_500 - x) - log_c(100_000, 59_500) for x in range(9_500, 50_001)]
    assert row.wide == pytest.approx(sum(math.exp(v) for v in logs if v <= logs[30_000 - 9_500] + 1e-7), rel=1e-5)
    assert row.z == pytest.approx(0.05, abs=1e-7)


def weight(*parts):
    u = int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= c for c in stats.POISSON)


def test_auc_over_subjects_and_repeats_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(s, r, s % 2, float(np.round(rng.uniform() + 0.3 * (s % 2), 2))) for s in range(24) for r in range(4)]
    oof = spark.createDataFrame(rows, "subject long, repeat int, label int, prob double")
    got = {r.b: r.auc for r in stats.bootstrap_auc_repeats(oof, "subject", "repeat", "label", "prob", 6).collect()}
    for b in range(1, 7):
        w = {r: weight("repeat", r, b) for r in range(4)}
        if not sum(w.values()):
            assert b not in got
            continue
        mean = {s: sum(w[r] * p for i, r, _, p in rows if i == s) / sum(w.values()) for s in range(24)}
        own = {s: weight(s, b) for s in range(24)}
        pairs = [(own[i] * own[j], (mean[i] > mean[j]) + 0.5 * (abs(mean[i] - mean[j]) < 1e-12)) for i in range(1, 24, 2) for j in range(0, 24, 2)]
        assert got[b] == pytest.approx(sum(n * v for n, v in pairs) / sum(n for n, _ in pairs), abs=0.02)


def test_sheets(spark):
    sheet = spark.createDataFrame([("2010001.0", " MDD", "23", "M", "12"), ("02010002", "hc", "x", "F", None)], ["Subject No", "Diagnostic Group", "Age", "Gender", "Education (years)"])
    got = metadata.normalise(sheet).orderBy("subject_id").collect()
    assert [(r.subject_id, r.label, r.age, r.sex, r.education_years, r.id_prefix) for r in got] == [("02010001", 1, 23.0, 1.0, 12.0, "0201"), ("02010002", 0, None, 0.0, None, "0201")]
    assert metadata.normalise(spark.createDataFrame([("1", "HC")], ["id", "class"])).first().label == 0
    for rows, columns in (([("1", "HC"), ("1", "HC")], ["id", "class"]), ([("1", "other")], ["id", "type"]), ([("1", "HC", "HC")], ["id", "type", "class"]), ([("1", "2")], ["id", "age"])):
        with pytest.raises(ValueError):
            metadata.normalise(spark.createDataFrame(rows, columns))
    with pytest.raises(ValueError, match="empty"):
        metadata.normalise(spark.createDataFrame([], "id string, type string"))


def test_recordings_are_parsed_by_the_contract():
    cfg = Acquisition()
    assert signals.parse_samples(b"1 2 3\n4 5 6\n", cfg).tolist() == [[1, 4], [2, 5], [3, 6]]
    for content in (b"", b"1 2\n", b"1 2 3.5\n", b"1 2 nan\n"):
        with pytest.raises(ValueError):
            signals.parse_samples(content, cfg)
    level = np.abs(signals.synthetic(250, 60, settle_s=20)).reshape(3, 6, -1).mean(axis=2)
    assert (level[:, 0] > 1.5 * level[:, 3]).all() and np.allclose(level[:, 3], level[:, 5], rtol=0.2)


def test_hjorth_work_grows_with_the_length_not_its_square(spark):
    """A mean is computed once for an array: the same number of samples in ten times longer epochs takes about as long, not ten times."""
    import time

    def seconds(n, rows):
        x = spark.range(rows, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i * i + F.col("id"))).alias("x")).localCheckpoint()
        found = x.select(*(c.alias(k) for k, c in complexity.hjorth(F.col("x")).items())).agg(F.sum("mobility"), F.sum("complexity"))
        found.collect()
        began = time.perf_counter()
        found.collect()
        return time.perf_counter() - began

    assert seconds(3000, 20) < 3 * seconds(300, 200) + 1  # the same number of samples
