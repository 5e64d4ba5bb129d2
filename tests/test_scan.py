"""Filters and lags over series cut into pieces equal those over whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import pieces, scan
from tidegrid.operators.filtering import band_pass_coefficients, engine_for, forward_backward, notch_coefficients, one_sided_coefficients

FILTERS = {"band": band_pass_coefficients(1.0, 40.0, 128.0), "low": one_sided_coefficients(20.0, 128.0, "low"), "high": one_sided_coefficients(2.0, 128.0, "high"), "notch": notch_coefficients(50.0, 30.0, 128.0)}


def series(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    data = {name: rng.normal(size=n).cumsum() / 5 + rng.normal(size=n) for name, n in lengths.items()}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "name string, t long, v double").orderBy(F.xxhash64("t", "name"))


def filtered(df, kind, **more):
    out = {}
    for r in scan.zero_phase(df, ["name"], ["t"], "v", *FILTERS[kind], **more).collect():
        out.setdefault(r.name, []).append((r.t, r.filtered))
    return {k: np.array([y for _, y in sorted(v)], float) for k, v in out.items()}


@pytest.mark.parametrize("kind", FILTERS)
def test_a_record_over_eight_tasks_equals_an_unsplit_run(spark, kind):
    data, df = series(spark, {"one": 6000, "two": 70, "three": 400})
    got = filtered(df, kind, partitions=8, size=500)
    for name, x in data.items():
        assert np.abs(got[name] - forward_backward(x[None], *FILTERS[kind])[0]).max() < 1e-9


@pytest.mark.parametrize("size", [1, 7, 100])
def test_any_cut_gives_the_same(spark, size):
    data, df = series(spark, {"one": 300, "two": 45})
    got = filtered(df, "band", partitions=5, size=size)
    for name, x in data.items():
        assert np.abs(got[name] - forward_backward(x[None], *FILTERS["band"])[0]).max() < 1e-9


def test_short_null_and_missing_series(spark):
    _, df = series(spark, {"one": 200, "short": 27, None: 60})
    got = filtered(df.withColumn("v", F.when(~((F.col("name") == "one") & (F.col("t") == 150)), F.col("v"))), "band", partitions=3, size=40)
    assert got["short"].tolist() != [] and np.isnan(got["short"]).all() and len(got["short"]) == 27
    assert np.isnan(got["one"]).all() and np.isfinite(got[None]).all()
    assert filtered(df.filter("false"), "band") == {}


@pytest.mark.parametrize("kind", FILTERS)
def test_blocks_equal_the_recursion_in_extended_precision(kind):
    b, a = (np.array(c, np.longdouble) for c in FILTERS[kind])
    x = np.random.default_rng(3).normal(size=1500).cumsum()
    held, state, y = np.zeros(len(a) - 1, np.longdouble), np.zeros(len(a) - 1, np.longdouble), []
    for v in x:
        y.append(b[0] * v + state[0])
        state = np.append(state[1:], held[0]) + b[1:] * v - a[1:] * y[-1]
    engine = engine_for(*map(tuple, FILTERS[kind]))
    assert np.abs(engine.run(x[None], np.zeros((1, len(a) - 1), complex))[0] - np.array(y, float)).max() < 1e-10
    steps = np.zeros(len(a) - 1, complex)
    for v in x:
        steps = engine.poles * steps + v
    assert engine.carry(x) == pytest.approx(steps, rel=1e-9)


@pytest.mark.parametrize("size,k", [(1, 5), (9, 4), (1000, 12)])
def test_offsets_and_halo(spark, size, k):
    data, df = series(spark, {"one": 150, "two": 3})
    cut = pieces.pack(df, ["name"], ["t"], ["t", "v"], 6, size)
    rows = pieces.halo(cut, ["name"], "v", k).join(pieces.offsets(cut, ["name"]).drop("n"), ["name", *pieces.PLACE]).collect()
    assert sum(r.n for r in rows) == 153 and all(r.n <= size and len(r.v) == r.n for r in rows)
    for r in rows:
        x = data[r.name]
        assert r.total == len(x) and r.t == list(range(r.offset, r.offset + r.n)) and r.v == x[r.offset : r.offset + r.n].tolist()
        assert r["__halo"] == x[max(0, r.offset - k) : r.offset].tolist()


def test_short_series_take_no_maps(spark, monkeypatch):
    """Series that no cut goes through are filtered where they are, in rows of one matrix, and equal single arrays."""
    rng = np.random.default_rng(8)
    x = {k: rng.normal(size=n) for k, n in enumerate([5, 15, 16, 40, 41, 66, 300])}
    df = spark.createDataFrame([(k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], "k long, t long, v double")
    monkeypatch.setattr(scan, "_combine", None)
    b, a = band_pass_coefficients(1.0, 20.0, 64.0, 2)
    got = {}
    for r in scan.zero_phase(df, ["k"], ["t"], "v", b, a, partitions=1).collect():
        got.setdefault(r.k, {})[r.t] = r.filtered
    for k, own in x.items():
        found = [got[k][i] for i in range(len(own))]
        if len(own) <= 15:
            assert found == [None] * len(own)
        else:
            assert np.allclose(found, forward_backward(own[None], b, a)[0], atol=1e-12)
