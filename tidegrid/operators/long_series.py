"""Spectra and complexity of series of any length, from partial sums over pieces.

A piece of a series (see ``pieces``) gives what it can alone: powers of the segments that lie in it, and for segments that a cut goes
through a partial transform, placed by its offset, which adds up with those of its neighbours; sums of steps and counts of patterns,
for which the last samples before the piece come with it (``pieces.halo``). All of these add up over tasks; nothing needs
a whole series in one place.

Defined results: a null sample counts as NaN and spoils what it takes part in; a series shorter than one segment has no spectrum here; null keys
are a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import TINY
from tidegrid.operators.pieces import PIECE, halo, offsets, pack, same

#: Segments that are transformed at once.
AT_ONCE = 256


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, partitions: int | None = None, size: int = PIECE, reach: int = 0) -> DataFrame:
    """(keys, place, n, offset, total, x[, __halo]): the pieces of each series with their places in it."""
    clean = df.select(*keys, *order, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x"))
    cut = pack(clean, keys, order, ["x"], partitions, size)
    own = cut.alias("a").join(offsets(cut, keys).alias("b"), same(keys)).select("a.*", "b.offset", "b.total")
    if not reach:
        return own
    return own.alias("a").join(halo(cut, keys, "x", reach).alias("b"), same(keys)).select("a.*", "b.__halo")


def _kinds(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _arrow_kinds(df: DataFrame, keys: Sequence[str]) -> list[pa.DataType]:
    return [f.type for f in df.limit(0).select(*keys).toArrow().schema] if keys else []


def _sum_arrays(df: DataFrame, by: Sequence[str], arrays: dict[str, int], sums: Sequence[str]) -> DataFrame:
    """One row for each ``by``: arrays added up element by element, and plain sums."""
    parts = [F.array(*(F.sum(F.get(a, F.lit(j))) for j in range(width))).alias(a) for a, width in arrays.items()]
    return df.groupBy(*by).agg(*parts, *(F.sum(s).alias(s) for s in sums))


def welch(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, fs: float, segment: int, overlap: float = 0.5, partitions: int | None = None, size: int = PIECE) -> DataFrame:
    """(keys, n_segments, density as an array of segment // 2 + 1 bins): mean periodogram of Hann-weighted, mean-free segments."""
    if segment < 3:
        raise ValueError("a segment has at least three samples")
    keys = list(keys)
    step = max(1, segment - int(segment * overlap))
    bins = segment // 2 + 1
    pieces = placed(df, keys, order, value, partitions, size)
    kinds = _arrow_kinds(pieces, keys)
    layout = ", ".join([*_kinds(pieces, keys), "__seg bigint", "__k int", "__n bigint", "__s double", "__re array<double>", "__im array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(segment) / segment)
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                x, offset, total = at["x"][i].values.to_numpy(zero_copy_only=False), at["offset"][i].as_py(), at["total"][i].as_py()
                last = (total - segment) // step if total >= segment else -1
                own = [at[k][i].as_py() for k in keys]
                first = max(0, -(-(offset - segment + 1) // step))
                inside = -(-offset // step), min(last, (offset + len(x) - segment) // step)
                power, count = np.zeros(bins), max(0, inside[1] - inside[0] + 1)
                if count:
                    views = np.lib.stride_tricks.sliding_window_view(x[inside[0] * step - offset :], segment)[::step][:count]
                    for j in range(0, count, AT_ONCE):
                        part = views[j : j + AT_ONCE]
                        power += (np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window)) ** 2).sum(axis=0)
                    rows.append((*own, -1, count, 0.0, power, np.zeros(bins)))
                for seg in [*range(first, min(inside[0], last + 1)), *range(max(inside[1] + 1, inside[0]), min(last, (offset + len(x) - 1) // step) + 1)]:
                    low, high = max(seg * step, offset), min(seg * step + segment, offset + len(x))
                    if low < high:
                        held, there = np.zeros(segment), slice(low - seg * step, high - seg * step)
                        held[there] = x[low - offset : high - offset]
                        z = np.fft.rfft(held * window)
                        rows.append((*own, seg, high - low, held.sum(), z.real, z.imag))
            # arrays are sent in short rows, so that sums of them are short plans
            k = np.arange(0, bins, 16)
            out: list[list] = [[] for _ in range(len(keys) + 6)]
            for *own, seg, n, s, re, im in rows:
                for j in k:
                    wide = lambda z: np.pad(z[j : j + 16], (0, max(0, j + 16 - bins))).tolist()  # noqa: B023, E731
                    for column, v in zip(out, (*own, seg, int(j), n, s, wide(re), wide(im)), strict=True):
                        column.append(v)
            types = [*kinds, pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*keys, "__seg", "__k", "__n", "__s", "__re", "__im"])

    parts = pieces.select(*keys, "offset", "total", "x").mapInArrow(run, layout)
    whole = parts.filter("__seg < 0").select(*keys, "__k", F.col("__n").alias("__count"), F.col("__re").alias("__p"))
    cut = _sum_arrays(parts.filter("__seg >= 0"), [*keys, "__seg", "__k"], {"__re": 16, "__im": 16}, ["__n", "__s"]).filter(F.col("__n") == segment)
    # the mean is taken off afterwards: the window's own transform is real, at bins 0 and 1
    effect = lambda j: F.when(F.col("__k") + j == 0, segment / 2).when(F.col("__k") + j == 1, -segment / 4).otherwise(0.0) * F.col("__s") / segment
    power = F.array(*((F.get("__re", F.lit(j)) - effect(j)) * (F.get("__re", F.lit(j)) - effect(j)) + F.get("__im", F.lit(j)) * F.get("__im", F.lit(j)) for j in range(16)))
    every = whole.unionByName(cut.select(*keys, "__k", F.lit(1).cast("bigint").alias("__count"), power.alias("__p")))
    sums = _sum_arrays(every, [*keys, "__k"], {"__p": 16}, ["__count"])
    scale = fs * segment * 0.375
    two = lambda i: F.when((i == 0) | (2 * i == segment), 1.0).otherwise(2.0)
    density = F.transform("__p", lambda v, j: v / F.col("__count") / scale * two(F.col("__k") + j))
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__k", density.alias("d")))), lambda x: x["d"]))
    return sums.groupBy(*keys).agg(F.max("__count").alias("n_segments"), F.slice(ordered, 1, bins).alias("density"))


def lag_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k_max: int = 10, partitions: int | None = None, size: int = PIECE) -> DataFrame:
    """(keys, n, mobility, complexity, perm_entropy, higuchi) of each series: Hjorth's figures, the normalised entropy of order-3 patterns and
    the slope of Higuchi's curve lengths, as ``complexity`` has them for arrays."""
    keys, reach = list(keys), max(k_max, 2)
    pieces = placed(df, keys, order, value, partitions, size, reach)
    spreads = [f"__{s}{d}" for d in range(3) for s in ("w", "m", "q")]  # count, mean and squared distances of the values and their first two differences
    names = [f"__c{c}" for c in range(8)] + [f"__l{k}_{m}" for k in range(1, k_max + 1) for m in range(k)]
    layout = ", ".join([*_kinds(pieces, keys), "__n bigint", "__v array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            sizes, found = [], []
            for i in range(batch.num_rows):
                before = at["__halo"][i].values.to_numpy(zero_copy_only=False)
                x = np.concatenate([before, at["x"][i].values.to_numpy(zero_copy_only=False)])
                old, place = len(before), at["offset"][i].as_py() - len(before)
                sums: list[float] = []
                for d in range(3):
                    steps = np.diff(x, n=d)[max(0, old - d) :] if len(x) > d else np.empty(0)
                    mean = steps.mean() if len(steps) else 0.0
                    sums += [len(steps), mean, ((steps - mean) ** 2).sum()]
                a, b, c = (x[max(0, old - 2) + j : max(0, len(x) - 2) + j] for j in range(3)) if len(x) > 2 else np.empty((3, 0))
                sums += np.bincount((a <= b) * 4 + (b <= c) * 2 + (a <= c), minlength=8).tolist()
                for k in range(1, k_max + 1):
                    ends = np.arange(max(k, old), len(x))
                    sums += np.bincount((place + ends) % k, np.abs(x[ends] - x[ends - k]), k).tolist()
                sizes.append(len(x) - old)
                found.append(sums)
            yield pa.RecordBatch.from_arrays([*(at[k] for k in keys), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=[*keys, "__n", "__v"])

    parts = pieces.select(*keys, "offset", "x", "__halo").mapInArrow(run, layout)
    parts = parts.select(*keys, "__n", *(F.get("__v", F.lit(j)).alias(name) for j, name in enumerate(spreads + names)))
    own = Window.partitionBy(*keys)
    middles = {f"__a{d}": F.try_divide(F.sum(F.col(f"__w{d}") * F.col(f"__m{d}")).over(own), F.sum(f"__w{d}").over(own)) for d in range(3)}
    apart = lambda d: F.col(f"__q{d}") + F.col(f"__w{d}") * F.pow(F.col(f"__m{d}") - F.col(f"__a{d}"), 2)
    sums = parts.withColumns(middles).groupBy(*keys).agg(F.sum("__n").alias("n"), *(F.sqrt(F.try_divide(F.sum(apart(d)), F.sum(f"__w{d}"))).alias(f"__sd{d}") for d in range(3)), *(F.sum(c).alias(c) for c in names))
    n, sd = F.col("n"), lambda d: F.col(f"__sd{d}")
    mobility = sd(1) / (sd(0) + TINY)
    shares = [F.try_divide(F.col(f"__c{c}"), n - 2) for c in range(8)]
    entropy = sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in shares), F.lit(0.0)) / math.log(6)
    points = [_curve(n, k) for k in range(1, k_max + 1)]
    return sums.select(*keys, "n", mobility.alias("mobility"), ((sd(2) / (sd(1) + TINY)) / (mobility + TINY)).alias("complexity"), F.when(n > 3, entropy).alias("perm_entropy"), _slope(points).alias("higuchi"))


def _curve(n: Column, k: int) -> tuple[float, Column]:
    """(log of 1 / k, log of the mean curve length at lag k); null where no curve has two points."""
    lengths = []
    for m in range(k):
        count = F.floor((n - 1 - m) / k)  # steps of the curve that starts at m
        lengths.append(F.when(count > 0, F.try_divide(F.col(f"__l{k}_{m}") * (n - 1), count * k)))
    some = sum((x.isNotNull().cast("int") for x in lengths), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in lengths), F.lit(0.0)), some)
    return -math.log(k), F.ln(mean + TINY)


def _slope(points: Sequence[tuple[float, Column]]) -> Column:
    """Slope of the line through the points whose second is not null, from two points up."""
    one = lambda f: sum((F.when(y.isNotNull(), f(x, y)).otherwise(0.0) for x, y in points), F.lit(0.0))
    n, sx, sy, sxx, sxy = (one(f) for f in (lambda x, y: F.lit(1.0), lambda x, y: F.lit(x), lambda x, y: y, lambda x, y: F.lit(x * x), lambda x, y: x * y))
    return F.when(n >= 2, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))
