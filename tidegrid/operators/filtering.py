"""Recursive filters and averaged periodograms for packed recordings, vectorised over channels.

These run inside Arrow batches of recordings: a filter's output depends on all samples before it, so a recording is its
unit of work, and recordings are spread over tasks.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from tidegrid.config import TINY


def band_pass_coefficients(low: float, high: float, fs: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth band-pass in transfer-function form: prototype poles, band transform, bilinear transform."""
    prototype = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = 2 * fs * np.tan(math.pi * np.array([low, high]) / fs)
    width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    return _digital(np.zeros(order), poles, width**order, fs)


def one_sided_coefficients(cut: float, fs: float, kind: str, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth low-pass or high-pass."""
    prototype = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = 2 * fs * math.tan(math.pi * cut / fs)
    if kind == "low":
        return _digital(np.empty(0), prototype * warped, warped**order, fs)
    return _digital(np.zeros(order), warped / prototype, 1.0, fs)


def _digital(zeros: np.ndarray, poles: np.ndarray, gain: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    two = 2 * fs
    gain = gain * np.real(np.prod(two - zeros) / np.prod(two - poles))
    z = np.concatenate([(two + zeros) / (two - zeros), -np.ones(len(poles) - len(zeros))])
    return gain * np.real(np.poly(z)), np.real(np.poly((two + poles) / (two - poles)))


def notch_coefficients(hz: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch with unit gain away from ``hz``."""
    w = 2 * math.pi * hz / fs
    gain = 1 / (1 + math.tan(w / q / 2))
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


class Recursive:
    """A filter as a sum of one-pole parts: y = b0 x + sum(r s), s' = p s + x for each pole p with its residue r.

    The parts don't disturb each other, so that a block of samples is one well-conditioned matrix product on them and on the state
    before, and any number of steps of a state is a power of each pole. Poles must be distinct, as those of all filters here are.
    """

    BLOCK = 64

    def __init__(self, b: np.ndarray, a: np.ndarray) -> None:
        n = max(len(a), len(b))
        wide_b, wide_a = np.zeros(n, np.longdouble), np.zeros(n, np.longdouble)
        wide_b[: len(b)], wide_a[: len(a)] = b / a[0], a / a[0]
        rest, slope = wide_b[1:] - wide_b[0] * wide_a[1:], wide_a[:-1] * np.arange(n - 1, 0, -1)
        poles = np.roots(wide_a.astype(float)).astype(np.clongdouble)
        for _ in range(4):  # the double coefficients' poles in extended precision
            poles = poles - np.polyval(wide_a, poles) / np.polyval(slope, poles)
        apart = np.abs(poles[:, None] - poles[None]) + np.eye(n - 1)
        if len(poles) != n - 1 or not np.isfinite(poles).all() or apart.min() < 1e-6:
            raise ValueError("a filter with repeated poles")
        residues, size = np.polyval(rest, poles) / np.polyval(slope, poles), self.BLOCK
        powers = poles[None] ** np.arange(size + 1)[:, None]
        impulse = np.concatenate([wide_b[:1], (powers[: size - 1] @ residues).real]).astype(float)
        lag = np.arange(size)[:, None] - np.arange(size)[None]
        self.b0, self.poles, self.residues = float(wide_b[0]), poles.astype(complex), residues.astype(complex)
        self.steady = (1 / (1 - poles)).astype(complex)
        self.direct = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.carried = (powers[:size] * residues).astype(complex)
        self.advance = powers[size].astype(complex)
        self.gather = powers[size - 1 :: -1].T.astype(complex)[:, -size:]

    def run(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """x(channels, n) and state(channels, poles) to the output of the same shape as x."""
        out, size = np.empty(x.shape), self.BLOCK
        whole = x.shape[1] // size * size
        for at in range(0, whole, size):
            part = x[:, at : at + size]
            out[:, at : at + size] = part @ self.direct.T + (state @ self.carried.T).real
            state = state * self.advance + part @ self.gather.T
        for at in range(whole, x.shape[1]):
            out[:, at] = self.b0 * x[:, at] + (state @ self.residues).real
            state = state * self.poles + x[:, at, None]
        return out

    def carry(self, x: np.ndarray) -> np.ndarray:
        """The state that samples x(n) leave behind when they start from rest."""
        state, size = np.zeros(len(self.poles), complex), self.BLOCK
        whole = len(x) // size * size
        for at in range(0, whole, size):
            state = state * self.advance + self.gather @ x[at : at + size]
        for v in x[whole:]:
            state = state * self.poles + v
        return state


@functools.lru_cache(maxsize=16)
def engine_for(b: tuple[float, ...], a: tuple[float, ...]) -> Recursive:
    """One engine for each filter in a worker, whatever the number of recordings and directions."""
    return Recursive(np.array(b), np.array(a))


def forward_backward(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd extension at both ends and steady initial states."""
    edge = 3 * max(len(a), len(b))
    if x.shape[1] <= edge:
        raise ValueError(f"signal too short to filter: {x.shape[1]} samples")
    engine = engine_for(tuple(b), tuple(a))
    padded = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
    for _ in range(2):
        padded = engine.run(padded, padded[:, :1] * engine.steady)[:, ::-1]
    return padded[:, edge:-edge]


#: Samples of a matrix of series that are filtered at once, about.
AT_ONCE = 1 << 20


def forward_backward_ragged(x: np.ndarray, ends: np.ndarray, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward`` of many series, x[ends[i]:ends[i + 1]], and which of them are too short for it (their samples are NaN).

    Series of like lengths are rows of a matrix, filled up behind: what a filter has put out does not depend on what comes after.
    """
    edge, engine, sizes = 3 * max(len(a), len(b)), engine_for(tuple(b), tuple(a)), np.diff(ends)
    out, short = np.full(len(x), np.nan), sizes <= edge
    order = np.argsort(sizes, kind="stable")
    order, at = order[~short[order]], 0
    while at < len(order):
        least = sizes[order[at]]
        end = min(np.searchsorted(sizes[order], least + max(8, least // 8), "right"), at + max(1, AT_ONCE // int(least + 2 * edge)))
        some, at = order[at:end], end
        n = sizes[some][:, None]
        wide = np.arange(n.max() + 2 * edge)[None]
        place = wide - edge  # mirrored at both ends
        place = np.where(place < 0, -place, np.where(place >= n, 2 * (n - 1) - place, place))
        start = ends[:-1][some][:, None]
        inside, own = wide < n + 2 * edge, x[start + np.clip(place, 0, n - 1)]
        first, last = x[start], x[start + n - 1]
        padded = np.where(inside, np.where(wide < edge, 2 * first - own, np.where(wide >= n + edge, 2 * last - own, own)), 0.0)
        turned = np.clip(n + 2 * edge - 1 - wide, 0, None)
        for _ in range(2):
            done = engine.run(padded, padded[:, :1] * engine.steady)
            padded = np.where(inside, np.take_along_axis(done, turned, axis=1), 0.0)
        kept = (wide >= edge) & (wide < n + edge)
        out[(start + wide - edge)[kept]] = padded[kept]
    return out, short


def welch(x: np.ndarray, fs: float, seconds: float, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): mean periodogram of Hann-weighted, mean-free segments along the last axis."""
    size = min(round(seconds * fs), x.shape[-1])
    step = max(1, size - int(size * overlap))
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]
    total, count = 0.0, parts.shape[-2]
    for at in range(0, count, 256):
        part = parts[..., at : at + 256, :]
        total = total + (np.abs(np.fft.rfft((part - part.mean(axis=-1, keepdims=True)) * window, axis=-1)) ** 2).sum(axis=-2)
    density = total / count / (fs * (window**2).sum())
    density[..., 1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, 1 / fs), density


def share(f: np.ndarray, p: np.ndarray, low: float, high: float, reference: tuple[float, float]) -> np.ndarray:
    inside, whole = (f >= low) & (f < high), (f >= reference[0]) & (f < reference[1])
    return p[..., inside].sum(axis=-1) / (p[..., whole].sum(axis=-1) + TINY)
