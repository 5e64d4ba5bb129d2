"""Time-domain complexity of epochs, as expressions over arrays and as numpy kernels for Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.config import TINY
from tidegrid.functions.expr import let, total


def diff(x: Column, lag: int = 1) -> Column:
    """x[i + lag] - x[i]."""
    keep = F.greatest(F.size(x) - lag, F.lit(0))
    return F.zip_with(F.slice(x, lag + 1, keep), F.slice(x, 1, keep), lambda a, b: a - b)


def sd(x: Column) -> Column:
    """``x`` should be a plain column or one that ``let`` has bound, as it is named several times."""
    # the mean is bound, or each element would compute it again
    return let(total(x) / F.size(x), lambda mean: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean)) / F.size(x)))


def hjorth(x: Column) -> dict[str, Column]:
    """Mobility and complexity. ``x`` should be a plain column, as it is named several times."""
    spread, first = sd(x), let(diff(x), sd)
    second = let(diff(x), lambda d: let(diff(d), sd))
    mobility = first / (spread + TINY)
    return {"mobility": mobility, "complexity": (second / (first + TINY)) / (mobility + TINY)}


def permutation_entropy(x: Column) -> Column:
    """Normalised entropy of the order-3 patterns; equal neighbours count as ascending, as a stable sort has them."""
    n = F.size(x) - 2
    codes = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.get(x, i) <= F.get(x, i + 1)).cast("int") * 4 + (F.get(x, i + 1) <= F.get(x, i + 2)).cast("int") * 2 + (F.get(x, i) <= F.get(x, i + 2)).cast("int"),
    )
    # of the eight codes, six are possible: up-up and down-down fix the third comparison
    counts = F.transform(F.array(*map(F.lit, (0, 2, 3, 4, 5, 7))), lambda c: F.size(F.filter(codes, lambda v: v == c)))
    share = lambda c: c / n
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, share(c) * F.ln(share(c))).otherwise(0.0))
    return F.when(n > 1, entropy / math.log(6))


def higuchi_slopes(x: np.ndarray, k_max: int = 10) -> np.ndarray:
    """Slope of Higuchi's curve lengths of each row; lengths are divided by k once, so a line has 0 and white noise 1."""
    n = x.shape[1]
    logs, scales = [], []
    for k in range(1, k_max + 1):
        lengths = [np.abs(np.diff(x[:, m::k], axis=1)).sum(axis=1) * (n - 1) / (len(range(m, n, k)) - 1) / k for m in range(k) if len(range(m, n, k)) > 1]
        if lengths:
            logs.append(np.log(np.mean(lengths, axis=0) + TINY))
            scales.append(-math.log(k))
    if len(scales) < 2:
        return np.full(len(x), np.nan)
    centred = np.array(scales) - np.mean(scales)
    return centred @ np.array(logs) / (centred @ centred)


@F.pandas_udf(T.DoubleType())
def higuchi_fd(x: pd.Series) -> pd.Series:
    out = pd.Series(np.full(len(x), np.nan))
    lengths = x.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for n in np.unique(lengths):
        if n > 2:
            rows = np.flatnonzero(lengths == n)
            out.iloc[rows] = higuchi_slopes(np.stack(x.iloc[rows].to_list()))
    return out.astype(object).where(out.notna(), None)
