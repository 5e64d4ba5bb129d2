"""Work on whole recordings: filtering, block profiles, quality metrics, rate check and epoch features.

A recording is one row and the unit of work; numpy kernels run in Arrow batches. Errors are caught for each recording and become
values of its ``error`` column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidegrid.config import MUSCLE_BAND, OCULAR_BAND, PRIMARY_FEATURES, PROFILE_BANDS, TINY, TOTAL_BAND, Settings
from tidegrid.operators.complexity import higuchi_slopes
from tidegrid.operators.filtering import band_pass_coefficients, forward_backward, notch_coefficients, share, welch
from tidegrid.operators.spectral import robust_lines

BLOCK = "block int, t_start double, rms double, ocular double, muscle double, prof array<double>"
QC = "finite boolean, flat_channels int, saturation_fraction double, zero_diff_fraction double, line_ratio_raw double, line_ratio_post double, notch_applied boolean, ocular_index double, muscle_ratio double, nonstationarity_cv double, min_channel_corr double, rms double, log_rms double"
FS_CHECK = "peak_hz double, prominence double, fs_status string, fs_supported boolean, implied_fs array<double>"
ANALYSED = f"subject_id string, task string, source_name string, n_samples long, duration_s double, n_wraparound_fixed long, filtered array<array<double>>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, {QC}, {FS_CHECK}, error string"


def line_ratio(data: np.ndarray, cfg: Settings) -> float:
    f, p = welch(data, cfg.acquisition.fs, 4.0)
    return float(np.median(share(f, p, cfg.acquisition.line_hz - 1, cfg.acquisition.line_hz + 1, (1.0, 45.0))))


def preprocess(data: np.ndarray, cfg: Settings) -> tuple[np.ndarray, bool, float]:
    """(filtered, notch applied, line ratio before): demean, conditional notch, band-pass, trim."""
    fs, own = cfg.acquisition.fs, cfg.filtering
    if own.demean == "before":
        data = data - data.mean(axis=1, keepdims=True)
    before = line_ratio(data - data.mean(axis=1, keepdims=True), cfg)
    notch = own.notch == "always" or (own.notch == "auto" and before > own.notch_ratio)
    if notch:
        data = forward_backward(data, *notch_coefficients(cfg.acquisition.line_hz, own.notch_q, fs))
    data = forward_backward(data, *band_pass_coefficients(own.low_hz, own.high_hz, fs, own.order))
    if own.demean == "after":
        data = data - data.mean(axis=1, keepdims=True)
    cut = round(own.trim_seconds * fs)
    if data.shape[1] <= 2 * cut:
        raise ValueError("recording is too short to trim")
    return data[:, cut : data.shape[1] - cut], notch, before


def profile_of(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    parts = np.array([share(f, p, low, high, TOTAL_BAND).mean() for low, high in PROFILE_BANDS.values()])
    return parts / parts.sum() if parts.sum() > 0 else np.full(len(parts), 1 / len(parts))


def blocks_of(data: np.ndarray, fs: float, seconds: float) -> list[dict]:
    """Full tumbling blocks with their amplitude and spectral profile."""
    size, out = int(round(fs * seconds)), []
    for k in range(data.shape[1] // size):
        part = data[:, k * size : (k + 1) * size]
        f, p = welch(part, fs, 4.0)
        out.append(dict(block=k, t_start=k * seconds, rms=float(np.median(np.sqrt((part**2).mean(axis=1)))), ocular=float(np.median(share(f, p, *OCULAR_BAND, TOTAL_BAND))), muscle=float(np.median(share(f, p, *MUSCLE_BAND, TOTAL_BAND))), prof=profile_of(f, p).tolist()))
    return out


def quality_of(raw: np.ndarray, filtered: np.ndarray, before: float, notch: bool, cfg: Settings) -> dict:
    fs, rail = cfg.acquisition.fs, 2 ** (cfg.acquisition.adc_bits - 1)
    f, p = welch(filtered, fs, 4.0)
    size = int(round(10 * fs))
    variances = [filtered[:, k * size : (k + 1) * size].var(axis=1).mean() for k in range(filtered.shape[1] // size)]
    steady = float(np.std(variances) / np.mean(variances)) if len(variances) >= 3 and np.mean(variances) > 0 else None
    varies = filtered.std(axis=1) > 0
    upper = np.corrcoef(filtered)[np.triu_indices(len(filtered), 1)] if varies.all() else np.array([])
    rms = float(np.median(np.sqrt((filtered**2).mean(axis=1))))
    return dict(
        finite=bool(np.isfinite(raw).all()),
        flat_channels=int((np.ptp(raw, axis=1) == 0).sum()),
        saturation_fraction=float(((raw <= -rail) | (raw >= rail - 1)).mean()),
        zero_diff_fraction=float((np.diff(raw, axis=1) == 0).mean()),
        line_ratio_raw=before,
        line_ratio_post=line_ratio(filtered, cfg),
        notch_applied=notch,
        ocular_index=float(np.median(share(f, p, *OCULAR_BAND, TOTAL_BAND))),
        muscle_ratio=float(np.median(share(f, p, *MUSCLE_BAND, TOTAL_BAND))),
        nonstationarity_cv=steady,
        min_channel_corr=float(upper.min()) if len(upper) else None,
        rms=rms,
        log_rms=math.log10(rms + TINY),
    )


def line_peak(f: np.ndarray, p: np.ndarray, cfg: Settings) -> dict:
    """Whether the strongest line of a spectrum from 35 Hz up lies at a mains frequency; the rates at which it would."""
    own = cfg.acquisition
    inside = (f >= 35) & (f <= min(70.0, own.fs / 2 - 1))
    logs = np.log10(p[inside] + TINY)
    if len(logs) < 8:
        return dict(peak_hz=None, prominence=None, fs_status="insufficient_band", fs_supported=False, implied_fs=None)
    at = int(logs.argmax())
    peak, height = float(f[inside][at]), float(logs[at] - np.median(logs))
    status, implied = "no_line_peak_detected_inconclusive", []
    if height >= own.mains_prominence:
        near = any(abs(peak - hz) <= own.mains_tolerance_hz for hz in own.mains_hz)
        status, implied = f"line_peak_at_{'expected' if near else 'unexpected'}_frequency", [own.fs * hz / peak for hz in own.mains_hz]
    return dict(peak_hz=peak, prominence=height, fs_status=status, fs_supported=status == "line_peak_at_expected_frequency", implied_fs=implied)


def check_rate(data: np.ndarray, cfg: Settings) -> dict:
    """The line check of a recording under the assumed sampling rate."""
    f, p = welch(data - data.mean(axis=1, keepdims=True), cfg.acquisition.fs, 8.0)
    return line_peak(f, np.median(p, axis=0), cfg)


def analyse(recordings: DataFrame, cfg: Settings) -> DataFrame:
    """One fused pass over each recording: rate check, filtering, blocks and quality metrics."""
    names = [c.split()[0] for c in ANALYSED.replace("array<struct<", "array<struct").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                out = dict.fromkeys(names) | {k: row[k] for k in ("subject_id", "task", "source_name", "n_samples", "duration_s", "n_wraparound_fixed", "error")}
                if row["data"] is not None:
                    try:
                        raw = np.stack(row["data"])
                        filtered, notch, before = preprocess(raw, cfg)
                        out |= check_rate(raw, cfg) | quality_of(raw, filtered, before, notch, cfg)
                        out |= {"filtered": list(filtered), "blocks": blocks_of(filtered, cfg.acquisition.fs, cfg.temporal.block_seconds)}
                    except (ValueError, np.linalg.LinAlgError) as error:
                        out["error"] = str(error)[:200]
                yield pd.DataFrame([out])

    return recordings.mapInPandas(run, ANALYSED)


def epoch_features(x: np.ndarray, fs: float, cfg: Settings) -> dict[str, np.ndarray]:
    """Features of epochs (n_epochs, channels, samples): arrays (n_epochs, channels)."""
    shape = x.shape[:2]
    f, p = welch(x, fs, cfg.epochs.welch_seconds)
    out = {f"rel_{n}": share(f, p, *PROFILE_BANDS[n], TOTAL_BAND) for n in ("delta", "theta", "alpha", "beta")}
    inside = (f >= TOTAL_BAND[0]) & (f < TOTAL_BAND[1])
    q = p[..., inside] / (p[..., inside].sum(axis=-1, keepdims=True) + TINY)
    out["spec_entropy"] = -(q * np.log(q + TINY)).sum(axis=-1) / math.log(inside.sum())
    fit = (f >= 3) & (f < 35)
    slope, r2, flat = robust_lines(p[..., fit].reshape(-1, fit.sum()), f[fit])
    out |= {"aperiodic_slope": slope.reshape(shape), "aperiodic_r2": r2.reshape(shape)}
    alpha = (f[fit] >= 7) & (f[fit] < 13)
    bumps = flat[:, alpha]
    out["alpha_peak_hz"] = np.where(bumps.max(axis=1) >= 0.05, f[fit][alpha][bumps.argmax(axis=1)], np.nan).reshape(shape)
    d1, d2 = np.diff(x, axis=-1), np.diff(x, n=2, axis=-1)
    mobility = d1.std(axis=-1) / (x.std(axis=-1) + TINY)
    out |= {"hjorth_mobility": mobility, "hjorth_complexity": (d2.std(axis=-1) / (d1.std(axis=-1) + TINY)) / (mobility + TINY)}
    a, b, c = x[..., :-2], x[..., 1:-1], x[..., 2:]
    codes = (a <= b) * 4 + (b <= c) * 2 + (a <= c)
    shares = np.stack([(codes == k).mean(axis=-1) for k in (0, 2, 3, 4, 5, 7)])
    out["perm_entropy"] = -(shares * np.log(np.where(shares > 0, shares, 1))).sum(axis=0) / math.log(6)
    out["higuchi_fd"] = higuchi_slopes(x.reshape(-1, x.shape[-1])).reshape(shape)
    full = np.abs(np.fft.fft(x, axis=-1)) ** 2
    low = full <= full.mean(axis=-1, keepdims=True)
    out["c0_complexity"] = (full * low).sum(axis=-1) / (full.sum(axis=-1) + TINY)
    lf = share(f, p, *OCULAR_BAND, TOTAL_BAND)
    return out | {"__lf": lf, "__alpha_power": p[..., (f >= 8) & (f < 13)].sum(axis=-1)}


def good_epochs(x: np.ndarray, lf: np.ndarray, cfg: Settings) -> tuple[np.ndarray, dict[str, int]]:
    """Which epochs pass every rule on every channel, relative to the subject's own medians; rejections by rule."""
    own = cfg.epochs
    p2p, jump = np.ptp(x, axis=2), np.abs(np.diff(x, axis=2)).max(axis=2)
    ratio = lambda v: v / (np.median(v, axis=0) + TINY)
    rules = {
        "nonfinite": ~np.isfinite(x).all(axis=(1, 2)),
        "flat": ~(p2p.min(axis=1) > 0),
        "p2p_high": ~(ratio(p2p) <= own.p2p[1]).all(axis=1),
        "p2p_low": ~(ratio(p2p) >= own.p2p[0]).all(axis=1),
        "jump": ~(ratio(jump) <= own.jump).all(axis=1),
        "ocular_lf": ~(ratio(lf) <= own.low_share).all(axis=1),
    }
    return ~np.any(list(rules.values()), axis=0), {f"qc_n_rej_{k}": int(v.sum()) for k, v in rules.items()}


EXPLORATORY = ("perm_entropy", "higuchi_fd", "c0_complexity")


def feature_columns(channels: tuple[str, ...]) -> list[str]:
    out = [f"p__{k}" for k in PRIMARY_FEATURES] + [f"e__{k}_{c}" for k in PRIMARY_FEATURES for c in channels] + [f"e__iqr_{k}" for k in PRIMARY_FEATURES]
    out += ["e__faa", "e__aperiodic_r2", "e__alpha_detect_rate", *(f"e__{k}" for k in EXPLORATORY), *(f"e__{k}_{c}" for k in EXPLORATORY for c in channels)]
    return out


def _middle(v: np.ndarray, axis=None, how: str = "median"):
    kept = np.isfinite(v)
    if not kept.any():
        return np.nan if axis is None else np.full(np.delete(v.shape, axis), np.nan)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            return (np.nanmedian if how == "median" else np.nanmean)(np.where(kept, v, np.nan), axis=axis)


def window_features(data: np.ndarray, start: float, length: float, cfg: Settings) -> dict:
    """Features of one analysis window of a filtered recording; ValueError where a gate closes."""
    fs, own, channels = cfg.acquisition.fs, cfg.epochs, cfg.acquisition.channels
    a, b = round(start * fs), round((start + length) * fs)
    if b > data.shape[1]:
        raise ValueError(f"signal too short for the window: {data.shape[1]} < {b} samples")
    cut = data[:, a:b]
    size = round(own.seconds * fs)
    step = max(1, round(size * (1 - own.overlap)))
    n = (cut.shape[1] - size) // step + 1
    if n < 1:
        raise ValueError("no complete epoch")
    x = np.stack([cut[:, k * step : k * step + size] for k in range(n)])
    found = epoch_features(x, fs, cfg)
    good, rejected = good_epochs(x, found.pop("__lf"), cfg)
    share_rejected = float(1 - good.mean())
    if share_rejected > own.max_rejected:
        raise ValueError(f"too many epochs rejected: {share_rejected:.2f}")
    if good.sum() < own.min_good:
        raise ValueError(f"too few good epochs: {int(good.sum())}")
    found = {k: v[good] for k, v in found.items()}
    how, row = own.aggregate, {}
    for k in (*PRIMARY_FEATURES, *EXPLORATORY):
        v = found[k]
        over = _middle(v, axis=1)
        row[("p__" if k in PRIMARY_FEATURES else "e__") + k] = float(_middle(over, how=how))
        row |= {f"e__{k}_{c}": float(_middle(v[:, j], how=how)) for j, c in enumerate(channels)}
        if k in PRIMARY_FEATURES:
            kept = over[np.isfinite(over)]
            row[f"e__iqr_{k}"] = float(np.subtract(*np.percentile(kept, [75, 25]))) if len(kept) else np.nan
    power = found["__alpha_power"]
    row["e__faa"] = float(_middle(np.log(power[:, 2] + TINY) - np.log(power[:, 0] + TINY), how=how))
    row["e__aperiodic_r2"] = float(_middle(_middle(found["aperiodic_r2"], axis=1), how=how))
    row["e__alpha_detect_rate"] = float(np.isfinite(found["alpha_peak_hz"]).mean())
    parts = blocks_of(cut, fs, min(cfg.temporal.block_seconds, length / 3))
    rms, prof = np.array([p["rms"] for p in parts]), np.array([p["prof"] for p in parts])
    own_median = np.median(prof, axis=0)
    row |= {"drift_log2_rms": float(np.log2((rms.max() + TINY) / (rms.min() + TINY))), "drift_js": max(_js(p, own_median) for p in prof), "drift_rms_spearman": _spearman(np.arange(len(rms)), rms)}
    return row | rejected | {"n_epochs_window": n, "n_epochs_used": int(good.sum()), "frac_epochs_rejected": share_rejected}


def _spearman(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of average ranks; NaN where a side doesn't vary."""
    ranks = []
    for v in (a, b):
        _, group, count = np.unique(v, return_inverse=True, return_counts=True)
        ranks.append((np.cumsum(count) - (count - 1) / 2)[group])
    return float(np.corrcoef(*ranks)[0, 1]) if all(np.ptp(r) > 0 for r in ranks) else math.nan


def _js(p: np.ndarray, q: np.ndarray) -> float:
    p, q = (np.maximum(v, 1e-12) for v in (p, q))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2)


def features(analysed: DataFrame, windows: list[tuple[str, float, float]], cfg: Settings) -> DataFrame:
    """One row per recording and window: its features, or the error that stopped them."""
    columns = feature_columns(cfg.acquisition.channels)
    rules = [f"qc_n_rej_{k}" for k in ("nonfinite", "flat", "p2p_high", "p2p_low", "jump", "ocular_lf")]
    counts = ["n_epochs_window", "n_epochs_used", *rules]
    doubles = ["frac_epochs_rejected", "drift_log2_rms", "drift_js", "drift_rms_spearman", *columns]
    schema = ", ".join(["subject_id string", "source_name string", "task string", "window_key string", "window_start double", "window_seconds double", *(f"{c} long" for c in counts), *(f"{c} double" for c in doubles), "error string"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for subject, source, task, data in zip(batch["subject_id"], batch["source_name"], batch["task"], batch["filtered"], strict=True):
                rows = []
                for key, start, length in windows:
                    row = dict.fromkeys(names) | {"subject_id": subject, "source_name": source, "task": task, "window_key": key, "window_start": start, "window_seconds": length}
                    try:
                        found = window_features(np.stack(data), start, length, cfg)
                        row |= {k: (None if isinstance(v, float) and not math.isfinite(v) else v) for k, v in found.items()}
                    except (ValueError, np.linalg.LinAlgError) as error:
                        row["error"] = str(error)[:200]
                    rows.append(row)
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in counts} | {c: float for c in doubles})

    found = analysed.filter("error is null").select("subject_id", "source_name", "task", "filtered").mapInPandas(run, schema)
    from pyspark.sql import functions as F

    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles})
