"""Selected quantiles equal sorted ones."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import selection

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 2.0**52, 2.0**53 + 2, 0.1, 1 / 3, math.nextafter(2.0, 0), math.nextafter(1024.0, 2000), 1e-310, 123456.789]


def test_codes_are_the_bits_and_come_back(spark):
    rng = np.random.default_rng(1)
    values = ODD + [float(v) for v in rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)] + [2.0**k for k in range(-1074, 1024, 3)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("c", selection.order_code(F.col("v")))
    for r in df.withColumn("back", selection.from_code(F.col("c"))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.c == (-bits - 1 if r.v < 0 else bits) and r.back == r.v
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double").select(selection.order_code(F.col("v")).alias("c"))
    assert [r.c for r in odd.collect()] == [None, None]


PROBS = {"low": 0.0, "p05": 0.05, "q25": 0.25, "median": 0.5, "p95": 0.95, "top": 1.0}


@pytest.mark.parametrize("most", [20_000, 0])
def test_quantiles_of_groups_with_ties_nulls_and_nan(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST", most)
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=700).tolist(), "b": rng.integers(-3, 3, 400).astype(float).tolist(), None: [2.5], "one": [1.0, 7.0], "gone": [None, math.nan], "far": [-math.inf, math.inf, 1e308, -1e308, 5.0]}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("a", None), ("b", math.nan)]
    got = {r.k: r for r in selection.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", PROBS).collect()}
    assert got.keys() == groups.keys() and got["gone"].n == 0 and got["gone"].median is None
    for k, x in groups.items():
        x = [v for v in x if v is not None and not math.isnan(v)]
        for name, p in PROBS.items():
            if x and k != "far":
                assert got[k][name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-15)
    assert (got["far"].low, got["far"].median, got["far"].top) == (-math.inf, 5.0, math.inf)


def test_whole_table_and_empty_table(spark):
    df = spark.createDataFrame([(float(v % 10),) for v in range(101)], "v double")
    row = selection.quantiles(df, [], "v", {"m": 0.5}).first()
    assert (row.n, row.m) == (101, 4.0)
    row = selection.quantiles(df.filter("v > 100"), [], "v", {"m": 0.5}).first()
    assert (row.n, row.m) == (0, None)


@pytest.mark.parametrize("most", [20_000, 0])
def test_median_deviation(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "MOST", most)
    rng = np.random.default_rng(3)
    x = {k: rng.normal(size=n).round(2) for k, n in (("a", 301), ("b", 40))}
    df = spark.createDataFrame([(k, float(v)) for k, own in x.items() for v in own], "k string, v double")
    for r in selection.median_deviation(df, ["k"], "v").collect():
        assert r.median == pytest.approx(np.median(x[r.k])) and r.mad == pytest.approx(np.median(np.abs(x[r.k] - np.median(x[r.k]))))
    r = selection.median_deviation(df, [], "v").first()
    whole = np.concatenate(list(x.values()))
    assert r.mad == pytest.approx(np.median(np.abs(whole - np.median(whole))))


def test_the_table_is_read_once(spark):
    """Quantiles and the median distance come from one pass over the rows, whatever the number of passes over counts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), noted((F.col("id") % 50).cast("double")).alias("v"))
    assert {r.median for r in selection.quantiles(df, ["k"], "v", {"median": 0.5}).collect()} <= {24.0, 24.5, 25.0}
    assert seen.value == 1000
    selection.median_deviation(df, ["k"], "v").collect()
    assert seen.value == 2000
