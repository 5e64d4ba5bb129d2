"""Spectra of epochs and what is read from them.

The transform itself is numpy inside Arrow batches; bands, entropies, profiles and fits are expressions over the power array, so no
spectrum is ever exploded or shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.config import TINY, Acquisition
from tidegrid.functions.expr import total


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(x: pd.Series) -> pd.Series:
    """Squared magnitudes of the one-sided transform of each epoch; null for null or empty epochs."""
    out = pd.Series([None] * len(x), dtype=object)
    lengths = x.map(lambda v: -1 if v is None else len(v))
    for n in lengths.unique():
        if n > 0:
            rows = np.flatnonzero(lengths.to_numpy() == n)
            spectra = np.abs(np.fft.rfft(np.stack(x.iloc[rows].to_list()), axis=1)) ** 2
            for row, power in zip(rows, spectra, strict=True):
                out.iat[row] = power
    return out


def bins(low: float, high: float, step: float) -> tuple[int, int]:
    """First bin and end bin of the half-open band [low, high)."""
    return math.ceil(low / step - 1e-9), math.ceil(high / step - 1e-9)


def band(power: Column, low: float, high: float, step: float) -> Column:
    a, b = bins(low, high, step)
    return F.slice(power, a + 1, b - a)


def band_share(power: Column, low: float, high: float, step: float, reference: tuple[float, float] = (1.0, 40.0)) -> Column:
    """Power in [low, high) over the power in the reference band; not bounded by 1 if the one isn't inside the other."""
    return total(band(power, low, high, step)) / (total(band(power, *reference, step)) + TINY)


def spectral_entropy(power: Column, step: float, within: tuple[float, float] = (1.0, 40.0)) -> Column:
    """Shannon entropy of the normalised spectrum over its largest value."""
    chosen = band(power, *within, step)
    a, b = bins(*within, step)
    share = lambda p: p / (total(chosen) + TINY)
    return F.aggregate(chosen, F.lit(0.0), lambda s, p: s - share(p) * F.ln(share(p) + TINY)) / math.log(b - a)


def profile(power: Column, bands: dict[str, tuple[float, float]], step: float) -> Column:
    """Shares of the bands, as an array in their order."""
    return F.array(*(band_share(power, low, high, step) for low, high in bands.values()))


def mean_profile(df: DataFrame, keys: list[str], column: str, width: int, out: str) -> DataFrame:
    """Mean of the profiles of each group, scaled to sum 1; equal shares where there is no power."""
    means = df.groupBy(*keys).agg(F.array(*(F.avg(F.get(column, F.lit(i))) for i in range(width))).alias("__m"))
    even = F.array(*[F.lit(1.0 / width)] * width)
    scaled = F.transform("__m", lambda x: F.try_divide(x, total(F.col("__m"))))
    return means.select(*keys, F.when(total(F.col("__m")) > 0, scaled).otherwise(even).alias(out))


def line_fit(xs: Column, ys: Column) -> Column:
    """Least-squares line of paired arrays: struct(slope, intercept, r2)."""
    n = F.size(xs)
    mx, my = total(xs) / n, total(ys) / n
    sxy = total(F.zip_with(xs, ys, lambda a, b: (a - mx) * (b - my)))
    sxx, syy = total(F.transform(xs, lambda a: (a - mx) * (a - mx))), total(F.transform(ys, lambda b: (b - my) * (b - my)))
    slope = F.try_divide(sxy, sxx)
    return F.struct(slope.alias("slope"), (my - slope * mx).alias("intercept"), F.try_divide(sxy * sxy, sxx * syy).alias("r2"))


def aperiodic_line(df: DataFrame, power: str, step: float, within: tuple[float, float] = (3.0, 35.0)) -> DataFrame:
    """Adds ``fit``: the line of log10 power over log10 frequency in a band."""
    a, b = bins(*within, step)
    log_f = F.array(*(F.lit(math.log10(k * step)) for k in range(a, b)))
    log_p = F.transform(band(F.col(power), *within, step), lambda p: F.log10(p + TINY))
    return df.withColumns({"__x": log_f, "__y": log_p}).withColumn("fit", line_fit(F.col("__x"), F.col("__y"))).drop("__x", "__y")


def robust_lines(spectra: np.ndarray, freqs: np.ndarray, rounds: int = 5, peak_sd: float = 1.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope, r2, flattened log spectrum) of each row, dropping points far above the line from round to round.

    All rows are fitted together with weights 0 and 1; a row stops changing once its kept points repeat or would be fewer than five.
    """
    x, y = np.log10(freqs), np.log10(spectra + TINY)
    keep, moving = np.ones_like(y, bool), np.ones(len(y), bool)
    slope, icept = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        w = keep.astype(float)
        n = w.sum(axis=1)
        mx, my = (w * x).sum(axis=1) / n, (w * y).sum(axis=1) / n
        sxx = (w * (x - mx[:, None]) ** 2).sum(axis=1)
        sxy = (w * (x - mx[:, None]) * (y - my[:, None])).sum(axis=1)
        fitted = np.where(sxx > 0, sxy / np.where(sxx > 0, sxx, 1), 0)
        slope, icept = np.where(moving, fitted, slope), np.where(moving, my - fitted * mx, icept)
        residual = y - slope[:, None] * x - icept[:, None]
        mean = (w * residual).sum(axis=1) / n
        sd = np.sqrt((w * (residual - mean[:, None]) ** 2).sum(axis=1) / n) + TINY
        new = residual <= peak_sd * sd[:, None]
        enough = new.sum(axis=1) >= 5
        same = (new == keep).all(axis=1)
        keep = np.where((moving & enough)[:, None], new, keep)
        moving &= enough & ~same
    residual = y - slope[:, None] * x - icept[:, None]
    w = keep.astype(float)
    mean = (w * y).sum(axis=1) / w.sum(axis=1)
    r2 = 1 - (w * residual**2).sum(axis=1) / ((w * (y - mean[:, None]) ** 2).sum(axis=1) + TINY)
    return slope, r2, residual


def robust_aperiodic(step: float, within: tuple[float, float] = (3.0, 35.0)):
    """A pandas UDF from power arrays to struct(slope, r2, flat)."""
    a, b = bins(*within, step)
    freqs = np.arange(a, b) * step

    @F.pandas_udf("slope double, r2 double, flat array<double>")
    def run(power: pd.Series) -> pd.DataFrame:
        if not len(power):
            return pd.DataFrame({"slope": [], "r2": [], "flat": []})
        slope, r2, flat = robust_lines(np.stack([p[a:b] for p in power]), freqs)
        return pd.DataFrame({"slope": slope, "r2": r2, "flat": list(flat)})

    return run


def peak_hz(flat: Column, first_hz: float, step: float, low: float, high: float, least: float = 0.05) -> Column:
    """Frequency of the first largest value of a flattened spectrum in [low, high); null where it is lower than ``least``."""
    a, b = bins(low - first_hz, high - first_hz, step)
    part = F.slice(flat, max(a, 0) + 1, b - max(a, 0))
    at = F.array_position(part, F.array_max(part)) - 1
    return F.when(F.array_max(part) >= least, first_hz + (at + max(a, 0)) * step)


def c0(power: Column, n: int) -> Column:
    """Share of the energy outside the bins above the mean power, from the one-sided spectrum of n samples."""
    twice = F.transform(power, lambda p, k: p * F.when((k == 0) | (k == n / 2), 1.0).otherwise(2.0))
    mean = total(twice) / n
    rest = F.zip_with(power, twice, lambda p, two: F.when(p > mean, 0.0).otherwise(two))
    return total(rest) / (total(twice) + TINY)


def line_check(power: Column, step: float, cfg: Acquisition, low: float = 35.0, high: float = 70.0) -> Column:
    """Where the strongest line from ``low`` to ``high``, and to 1 Hz below half the sampling rate, lies: struct(peak_hz, prominence, status, implied rates)."""
    first, last = math.ceil(low / step - 1e-9), math.floor(min(high, cfg.fs / 2 - 1) / step + 1e-9)
    logs = F.transform(F.slice(power, first + 1, F.greatest(F.least(F.size(power), F.lit(last + 1)) - first, F.lit(0))), lambda p: F.log10(p + TINY))
    ordered = F.array_sort(logs)
    n = F.size(logs)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    hz = (F.array_position(logs, F.array_max(logs)) - 1 + first) * F.lit(float(step))
    height = F.array_max(logs) - middle
    near = F.array_min(F.array(*(F.abs(hz - c) for c in cfg.mains_hz))) <= cfg.mains_tolerance_hz
    status = F.when(n < 8, "insufficient_band").when(height < cfg.mains_prominence, "no_line_peak_detected_inconclusive")
    status = status.when(near, "line_peak_at_expected_frequency").otherwise("line_peak_at_unexpected_frequency")
    found = (n >= 8) & (height >= cfg.mains_prominence)
    implied = F.when(found, F.array(*(F.lit(cfg.fs * c) / hz for c in cfg.mains_hz))).when(n >= 8, F.array().cast("array<double>"))
    return F.struct(hz.alias("peak_hz"), height.alias("prominence"), status.alias("status"), implied.alias("implied_fs"))
