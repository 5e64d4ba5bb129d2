"""Operators for long tables against plain versions on small ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.config import Acquisition, Quality, Settings
from tidegrid.functions.expr import number
from tidegrid.operators import comoments, complexity, filtering, intervals, long_series, panes, relational, resampling, stats
from tidegrid.plans import cohort
from tidegrid.sources.signals import parse_samples


def plan(df):
    return df._jdf.queryExecution().toString()


# intervals


@pytest.mark.parametrize("width", [None, 0.7, 100.0])
def test_interval_join_equals_all_pairs(spark, width):
    rng = np.random.default_rng(1)
    samples = [(int(k), float(t)) for k, t in zip(rng.integers(0, 4, 300), rng.uniform(-20, 20, 300).round(1), strict=True)] + [(1, None), (None, 3.0), (2, 5.0), (2, 5.0)]
    windows = [(i, int(rng.integers(0, 5)), float(s), float(s + n)) for i, (s, n) in enumerate(zip(rng.uniform(-25, 20, 60).round(1), rng.exponential(3, 60).round(1), strict=True))]
    windows += [(90, 1, -1000.0, 1000.0), (91, 1, 3.0, 3.0), (92, 1, 4.0, 2.0), (93, 1, None, 5.0), (94, 2, 5.0, 5.1), (94, 2, 5.0, 5.1), (95, None, -9.0, 9.0)]
    a, b = spark.createDataFrame(samples, "k int, t double"), spark.createDataFrame(windows, "w int, k int, s double, e double")
    joined = intervals.interval_join(a, b, "t", "s", "e", ["k"], width)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    got = sorted((r.k, r.t, r.w) for r in joined.collect())
    assert got == sorted((k, t, w) for k, t in samples for w, q, s, e in windows if None not in (k, t, q, s, e) and k == q and s <= t < e)
    common = intervals.interval_join(a, b.drop("k"), "t", "s", "e", (), width)
    assert common.count() == sum(1 for _, t in samples for _, _, s, e in windows if None not in (t, s, e) and s <= t < e)
    assert intervals.interval_join(a, b.filter("false"), "t", "s", "e", ["k"]).count() == 0


# panes


@pytest.mark.parametrize("length,step", [(10, 1), (12, 8), (5, 5), (4, 6), (7, 3)])
def test_epochs_from_panes(spark, length, step):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(size=83) + 1e6, "b": rng.normal(size=length), "c": rng.normal(size=length - 1)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("gap", i, float(i)) for i in range(30) if i != 13] + [("null", i, None if i == 3 else 1.0) for i in range(25)]
    series |= {"gap": [float(i) if i != 13 else None for i in range(30)], "null": [None if i == 3 else 1.0 for i in range(25)]}
    got = {(r.k, r.epoch): r for r in panes.epochs(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v", length, step).collect()}
    expected = {}
    for k, x in series.items():
        for e in range(max(0, (len(x) - length) // step + 1)):
            part = list(x[e * step : e * step + length])
            if None not in part:
                expected[k, e] = np.array(part)
    assert got.keys() == expected.keys()
    for key, x in expected.items():
        r = got[key]
        assert (r.n, r.ptp) == (length, pytest.approx(np.ptp(x))) and r.mean == pytest.approx(x.mean()) and r.rms == pytest.approx(np.sqrt((x**2).mean()))
        assert r.variance == pytest.approx(x.var(), rel=1e-6, abs=1e-9)


def test_overlap_shuffles_no_more_rows(spark):
    df = spark.range(4000).select((F.col("id") % 4).alias("k"), F.floor(F.col("id") / 4).alias("i"), F.col("id").cast("double").alias("v"))
    text = plan(panes.epochs(df, ["k"], "i", "v", 40, 4))
    assert "Generate" not in text and "Expand" not in text


# resampling


def test_one_pass_bootstrap_equals_repeated_rows(spark):
    """The same hashes, with every row repeated for every sample."""
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(size=90))] + [(None, "a", 1.0), (7, "a", None), (8, "b", math.nan)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    moments, statistics = resampling.mean_of("v")
    one = {(r.g, r.b): r.mean for r in resampling.bootstrap(df, "id", ["g"], moments, statistics, 30, md5=True).collect()}
    clean = df.filter("id is not null and v is not null and not isnan(v)")
    many = {(r.g, r.b): r.mean for r in stats.bootstrap_means(clean, "id", ["g"], "v", 30).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in many)


def test_mixed_weights_are_poisson_and_statistics_are_right(spark, monkeypatch):
    h, b = np.random.default_rng(4).integers(0, 2**32, 3000), np.arange(1, 401)
    u = resampling.mixed(h, b)
    assert abs(u.mean() - 0.5) < 0.002 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(u[0], u[1])[0, 1]) < 0.15
    w = np.searchsorted(np.array(stats.POISSON), u, side="right")
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=200), rng.integers(0, 2, 200)
    y = x + rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(c), int(k)) for i, (a, c, k) in enumerate(zip(x, y, label, strict=True))], "id long, x double, y double, k int").repartition(3)
    monkeypatch.setattr(resampling, "STATE", 300)  # a state that is sent on again and again
    keys = [int(r.h, 16) for r in df.select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 8).alias("h")).orderBy("id").collect()]
    w = np.searchsorted(np.array(stats.POISSON), resampling.mixed(np.array(keys), np.arange(1, 26)), side="right").T
    for (moments, statistics), f in ((resampling.correlation_of("x", "y"), lambda r: np.corrcoef(np.repeat(x, r), np.repeat(y, r))[0, 1]), (resampling.hedges_of("x", "k"), lambda r: hedges(np.repeat(x, r), np.repeat(label, r)))):
        got = {r.b: r[1] for r in resampling.bootstrap(df, "id", [], moments, statistics, 25).collect()}
        assert [got[i] for i in range(1, 26)] == pytest.approx([f(r) for r in w])
    ends = resampling.intervals(resampling.bootstrap(df, "id", [], *resampling.mean_of("x"), 25), [], ["mean"]).first()
    assert ends.mean_low < x.mean() < ends.mean_high and ends.mean_n == 25


def hedges(x, k):
    a, b = x[k == 1], x[k == 0]
    pooled = np.sqrt(((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / np.sqrt(len(x) - 2)
    return (a.mean() - b.mean()) / pooled * (1 - 3 / (4 * len(x) - 9))


# long series


@pytest.mark.parametrize("size,segment,overlap", [(3, 16, 0.5), (50, 16, 0.75), (1000, 40, 0.0), (7, 5, 0.5)])
def test_spectra_of_pieces_equal_whole_ones(spark, size, segment, overlap):
    rng = np.random.default_rng(6)
    data = {"one": rng.normal(size=333).cumsum() + 50, "two": rng.normal(size=segment), "short": rng.normal(size=segment - 1)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "k string, i long, v double")
    got = {r.k: r for r in long_series.welch(df, ["k"], ["i"], "v", 64.0, segment, overlap, 6, size).collect()}
    assert got.keys() == {"one", "two"}
    for k, r in got.items():
        own = filtering.welch(data[k][None], 64.0, segment / 64.0, overlap)[1][0]
        assert r.n_segments == (len(data[k]) - segment) // max(1, segment - int(segment * overlap)) + 1
        assert r.density == pytest.approx(own, rel=1e-8, abs=1e-9)


@pytest.mark.parametrize("size", [1, 13, 1000])
def test_lag_features_of_pieces_equal_whole_ones(spark, size):
    rng = np.random.default_rng(7)
    data = {"one": rng.normal(size=240).cumsum() + 1e5, "two": rng.integers(0, 4, 60).astype(float)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "k string, i long, v double")
    whole = spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], "k string, x array<double>")
    parts = complexity.hjorth(F.col("x"))
    own = {r.k: r for r in whole.select("k", *(c.alias(n) for n, c in parts.items()), complexity.permutation_entropy(F.col("x")).alias("perm_entropy"), complexity.higuchi_fd("x").alias("higuchi")).collect()}
    for r in long_series.lag_features(df, ["k"], ["i"], "v", 10, 5, size).collect():
        assert r.n == len(data[r.k])
        for name in ("mobility", "complexity", "perm_entropy", "higuchi"):
            assert r[name] == pytest.approx(own[r.k][name], rel=1e-6)


# correlations of many channels


def test_correlations_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(comoments, "STATE", 1000)
    rng = np.random.default_rng(11)
    data = {k: rng.normal(size=(n, 19)) @ rng.normal(size=(19, 19)) + 1e6 for k, n in (("a", 60), ("b", 25))}
    data["b"][:, 3] = 7.0
    rows = [(k, v.tolist()) for k, x in data.items() for v in x] + [("a", None), ("a", [1.0] * 18), ("b", [math.nan] * 19), ("gone", [None] * 19)]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(4)
    found = comoments.correlations(df, ["k"], "x", 19).collect()
    assert {(r.k, r.i, r.j) for r in found} == {(k, i, j) for k in "ab" for i in range(19) for j in range(i + 1, 19)}
    own = {k: np.corrcoef(np.delete(x, 3, 1) if k == "b" else x, rowvar=False) for k, x in data.items()}
    for r in found:
        assert r.n == len(data[r.k])
        if r.k == "b" and 3 in (r.i, r.j):
            assert r.correlation is None
        else:
            shift = lambda c: c - (r.k == "b" and c > 3)  # noqa: B023, E731
            assert r.correlation == pytest.approx(own[r.k][shift(r.i), shift(r.j)], abs=1e-8)
    whole = comoments.smallest_correlation(df.filter("k = 'a'"), [], "x", 19).first()
    assert whole.min_corr == pytest.approx(own["a"].min(), abs=1e-8) and whole.n_pairs == 171


# ranks and exact law


def test_exact_law_equals_enumeration(spark):
    rng = np.random.default_rng(8)
    groups = {"a": ([1, 2.5, 3.1], [4.2, 5.7, 6.6, 7.9]), "b": (rng.normal(size=5).tolist(), rng.normal(size=7).tolist()), "one": ([2.0], [1.0, 3.0, 4.0]), "far": ([9.0, 8.0], [1.0, 2.0])}
    rows = [(g, float(v), k) for g, sides in groups.items() for k, side in enumerate(sides) for v in side]
    got = {r.g: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v", "k").collect()}
    assert got["a"].p == pytest.approx(0.05714285714)
    for g, (zero, one) in groups.items():
        values = sorted(zero + one)
        u = sum(a > b for a in one for b in zero)
        every = [sum(values[i] > values[j] for i in some for j in range(len(values)) if j not in some) for some in itertools.combinations(range(len(values)), len(one))]
        far = max(u, len(one) * len(zero) - u)
        assert got[g].u == u and got[g].p == pytest.approx(min(1, 2 * sum(x >= far for x in every) / len(every)))


def test_exact_law_of_uneven_groups_and_ties_go_their_ways(spark):
    rng = np.random.default_rng(9)
    rows = [("few", float(v), int(i < 8)) for i, v in enumerate(rng.permutation(208))] + [("tie", float(i // 2), i % 2) for i in range(8)] + [("many", float(v), int(i < 9)) for i, v in enumerate(rng.permutation(20))]
    got = {r.g: r.p for r in stats.mann_whitney(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v", "k").collect()}
    ways = {(0, 0): 1}  # ranks chosen one after the other
    for rank in range(1, 209):
        for (n, s), w in list(ways.items())[::-1]:
            if n < 8:
                ways[n + 1, s + rank] = ways.get((n + 1, s + rank), 0) + w
    own = sorted(v for g, v, k in rows if g == "few" and k)
    u = sum(own) - sum(range(8))
    law = {s - 36: w for (n, s), w in ways.items() if n == 8}
    tail = sum(w for s, w in law.items() if s <= min(u - 0, 8 * 200 - u))
    assert got["few"] == pytest.approx(2 * tail / sum(law.values()), rel=1e-9)
    assert got["tie"] == pytest.approx(1.0, abs=0.2) and 0 < got["many"] <= 1


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(10)
    rows = [("ab"[i % 2], float(v), int(i)) for i, v in enumerate(rng.permutation(200))]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(6)
    for keys, of in ((["k"], lambda r: [x for x in rows if x[0] == r.k]), ([], lambda r: rows)):
        for r in stats.running(df, keys, "v", ["n"]).collect():
            assert r.n_before == sum(x[2] for x in of(r) if x[1] < r.v)


# contract and settings


@pytest.mark.parametrize("text", [b"1 2 3\n4 5\n6 7 8 9\n10 11 12\n", b"1 2 3\n4 5 6 7\n", b"1 2 3\n4 x 6\n", b"", b"\n\n", b"1 2\n3 4\n", b"1 2 3\n4 nan 6\n", b"1 2 3.5\n"])
def test_broken_recordings_are_errors(text):
    with pytest.raises(ValueError):
        parse_samples(text, Acquisition())


def test_blank_lines_and_spaces_are_none():
    assert parse_samples(b"1 2 3\n\n 4\t5  6 \r\n", Acquisition()).tolist() == [[1, 4], [2, 5], [3, 6]]


def test_cohort_differences(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["p", "q", "q", None], ["q", "r", None]))
    assert sorted(map(tuple, relational.cohort_differences(a, b, "id").collect())) == [("p", "missing"), ("r", "unexpected")]


def test_nonstationarity_can_be_left_out():
    cfg = Settings(quality=Quality(use_nonstationarity=False, outliers=("log_rms", "nonstationarity_cv")))
    assert cfg.quality.cohort_metrics == ("log_rms",) and "nonstationarity_cv" not in {r.metric for r in cohort.rules_of(cfg)}
    assert "nonstationarity_cv" in {r.metric for r in cohort.rules_of(Settings())}
    with pytest.raises(ValueError):
        Quality(outliers=("log_rms", "log_rms"))


def test_numbers_of_any_text(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string").select(number(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == [1.5, None, None, None]
