"""Poisson bootstrap of any statistic of sums, in one pass.

Every row has a weight in each of n samples, from a hash of its key and the sample's number, so that no sample is drawn or stored and
a retried task gives the same weights. A statistic is a function of weighted sums ("moments"): a mean needs two, a
correlation six. Each task keeps one matrix (samples x moments) for each group and adds its rows' weights times moments to
it; the matrices of all tasks are added up after the shuffle. A row is never repeated for a sample.

Weights: the row's 32-bit hash (the first eight hex digits of the key's MD5) is mixed with the sample's number by two rounds of shifts and
multiplications modulo 2^32, and looked up in the cumulative Poisson distribution of mean 1; or, with ``md5``, a hash of key and number
as ``stats.bootstrap_means`` takes it, which is slower.

Defined results: rows with a null or NaN moment, or a null key, count in no sample; repeated rows share their weights; a
statistic that divides by zero is null in that sample and left out of intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.expr import finite
from tidegrid.operators.stats import POISSON

#: Rows whose weights are made at once, and numbers of a task's state before it is sent on.
ROWS, STATE = 512, 20_000_000
# An odd multiplier and shifts of a 32-bit mixer, and the step between samples.
MULTIPLIER, STEP = 0x45D9F3B, 0x9E3779B1


def mixed(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1), rows x samples, from 32-bit row hashes and sample numbers."""
    x = (h.astype(np.uint64)[:, None] + b.astype(np.uint64)[None] * np.uint64(STEP)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MULTIPLIER) & np.uint64(0xFFFFFFFF)
    return ((x >> np.uint64(16)) ^ x) / 2.0**32


def mixed_sql(h: str, b: str) -> str:
    """The same in SQL, for bigints."""
    x = f"(({h} + {b} * {STEP}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * {MULTIPLIER}) % 4294967296)"
    return f"(xor({x} >> 16, {x}) / 4294967296.0::DOUBLE)"


def _weights(key: pa.Array, b: np.ndarray, md5: bool) -> np.ndarray:
    if md5:
        u = np.array([[int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[:8], 16) for i in b] for k in key.to_pylist()]).reshape(len(key), len(b)) / 2.0**32
    else:
        u = mixed(key.to_numpy(zero_copy_only=False), b)
    return np.searchsorted(np.array(POISSON), u, side="right").astype(float)


def weighted_sums(df: DataFrame, key: str, by: Sequence[str], moments: Mapping[str, Column], n: int, md5: bool = False) -> DataFrame:
    """(by, b, one column for each moment): the sums of weight times moment in the samples 1 to n."""
    by, names = list(by), list(moments)
    plain = F.col(key).cast("string")
    hashed = plain if md5 else F.conv(F.substring(F.md5(plain), 1, 8), 16, 10).cast("bigint")
    rows = df.select(*by, hashed.alias("__key"), *(c.cast("double").alias(m) for m, c in moments.items()))
    good = rows.filter(F.col("__key").isNotNull())
    for m in names:
        good = good.filter(finite(F.col(m)))
    samples, width = np.arange(1, n + 1), len(names)
    layout = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "b int", *(f"`{m}` double" for m in names)])
    kinds = [f.type for f in df.limit(0).select(*by).toArrow().schema] if by else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, k) for v, k in zip(group, kinds, strict=True)), pa.array(samples.astype(np.int32)), *(pa.array(sums[:, j]) for j in range(width))], names=[*by, "b", *names])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                weights = _weights(part.column(len(by)), samples, md5)
                values = np.stack([part.column(len(by) + 1 + j).to_numpy(zero_copy_only=False) for j in range(width)], axis=1)
                groups = list(zip(*(part.column(j).to_pylist() for j in range(len(by))), strict=True)) if by else [()] * len(values)
                place: dict[tuple, list[int]] = {}
                for i, g in enumerate(groups):
                    place.setdefault(g, []).append(i)
                for g, own in place.items():
                    if g not in held:
                        if (len(held) + 1) * n * width > STATE:
                            yield from sent()
                        held[g] = np.zeros((n, width))
                    held[g] += weights[own].T @ values[own]
        yield from sent()

    return good.mapInArrow(run, layout).groupBy(*by, "b").agg(*(F.sum(m).alias(m) for m in names))


def bootstrap(df: DataFrame, key: str, by: Sequence[str], moments: Mapping[str, Column], statistics: Mapping[str, Column], n: int, md5: bool = False) -> DataFrame:
    """(by, b, one column for each statistic) of n samples; statistics are expressions on the moments' sums."""
    sums = weighted_sums(df, key, by, moments, n, md5)
    return sums.select(*by, "b", *(c.alias(s) for s, c in statistics.items()))


def intervals(samples: DataFrame, by: Sequence[str], statistics: Sequence[str], level: float = 0.95) -> DataFrame:
    """(by, <statistic>_low, _high and _n): the percentile interval of each statistic over its samples, of which there are n at most."""
    tail = (1 - level) / 2
    return samples.groupBy(*by).agg(*(c for s in statistics for c in (F.percentile(s, F.lit(tail)).alias(f"{s}_low"), F.percentile(s, F.lit(1 - tail)).alias(f"{s}_high"), F.count(s).alias(f"{s}_n"))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def scatter_of(squares: Column, total: Column, weight: Column) -> Column:
    """Sum of squared distances from the mean; 0 where it is less than what rounding leaves of the squares."""
    rest = squares - ratio(total * total, weight)
    return F.when(rest > 1e-12 * squares, rest).when(rest.isNotNull(), F.lit(0.0))


def mean_of(value: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(moments, statistics) of the mean."""
    return {"w": F.when(F.col(value).isNotNull(), F.lit(1.0)), "s": F.col(value)}, {"mean": ratio(F.col("s"), F.col("w"))}


def correlation_of(x: str, y: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(moments, statistics) of Pearson's correlation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    moments = {"w": F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0)), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    together = F.col("xy") - ratio(F.col("x") * F.col("y"), F.col("w"))
    spread = F.sqrt(scatter_of(F.col("xx"), F.col("x"), F.col("w")) * scatter_of(F.col("yy"), F.col("y"), F.col("w")))
    return moments, {"correlation": ratio(together, F.nullif(spread, F.lit(0.0)))}


def hedges_of(value: str, label: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """(moments, statistics) of Hedges g of the rows with label 1 against those with 0."""
    v, moments = F.col(value).cast("double"), {}
    for k in (1, 0):
        own = F.when(v.isNotNull() & F.col(label).isNotNull(), (F.col(label) == k).cast("double"))
        moments |= {f"n{k}": own, f"s{k}": own * v, f"q{k}": own * v * v}
    mean = lambda k: ratio(F.col(f"s{k}"), F.col(f"n{k}"))
    scatter = lambda k: scatter_of(F.col(f"q{k}"), F.col(f"s{k}"), F.col(f"n{k}"))
    total = F.col("n1") + F.col("n0")
    pooled = F.sqrt(ratio(scatter(1) + scatter(0), total - 2))
    g = ratio(mean(1) - mean(0), F.nullif(pooled, F.lit(0.0))) * (F.lit(1.0) - ratio(F.lit(3.0), 4 * total - 9))
    return moments, {"g": F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), g)}
