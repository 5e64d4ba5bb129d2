import numpy as np
import pytest

from tidegrid.config import Acquisition, Filtering, Settings, Temporal, check_model_columns
from tidegrid.operators import recordings
from tidegrid.operators.complexity import higuchi_slopes
from tidegrid.operators.filtering import Recursive, band_pass_coefficients, forward_backward, notch_coefficients, one_sided_coefficients, welch
from tidegrid.operators.spectral import robust_lines
from tidegrid.sources.signals import synthetic

FS = 250.0


def gain(b, a, hz):
    z = np.exp(-2j * np.pi * hz / FS * np.arange(max(len(a), len(b))))
    return abs((b * z[: len(b)]).sum() / (a * z[: len(a)]).sum())


def test_butterworth_and_notch_have_their_gains():
    b, a = band_pass_coefficients(1, 40, FS)
    assert gain(b, a, 10) == pytest.approx(1, abs=1e-3)
    assert gain(b, a, 1) == pytest.approx(2**-0.5, abs=1e-6) and gain(b, a, 40) == pytest.approx(2**-0.5, abs=1e-6)
    assert gain(b, a, 0.1) < 1e-3 and gain(b, a, 100) < 1e-2
    for kind, passes, stops in (("low", 1, 120), ("high", 120, 0.5)):
        b, a = one_sided_coefficients(20, FS, kind)
        assert gain(b, a, passes) == pytest.approx(1, abs=1e-3) and gain(b, a, stops) < 1e-2 and gain(b, a, 20) == pytest.approx(2**-0.5, abs=1e-6)
    b, a = notch_coefficients(50, 30, FS)
    assert gain(b, a, 50) < 1e-9 and gain(b, a, 10) == pytest.approx(1, abs=1e-2)


def test_blocks_of_a_recursive_filter_equal_the_recursion():
    rng = np.random.default_rng(0)
    b, a = band_pass_coefficients(2, 30, FS, 3)
    x = rng.standard_normal((2, 333))
    engine = Recursive(b, a)
    y = np.zeros_like(x)
    for n in range(x.shape[1]):
        y[:, n] = sum(b[k] * x[:, n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[:, n - k] for k in range(1, len(a)) if n >= k)
    assert np.allclose(engine.run(x, np.zeros((2, len(a) - 1))), y, atol=1e-8)


def test_zero_phase_keeps_a_tone_in_place():
    t = np.arange(5000) / FS
    x = np.sin(2 * np.pi * 10 * t)[None]
    y = forward_backward(x, *band_pass_coefficients(1, 40, FS))
    assert np.abs(y - x)[0, 500:-500].max() < 5e-3
    with pytest.raises(ValueError):
        forward_backward(x[:, :10], *band_pass_coefficients(1, 40, FS))


def test_welch_integrates_to_the_variance():
    x = np.random.default_rng(1).standard_normal((3, 20_000))
    f, p = welch(x, FS, 4.0)
    assert np.allclose(p.sum(axis=1) * (f[1] - f[0]), 1, atol=0.1) and f[-1] == FS / 2


def test_rate_check_finds_the_line():
    t = np.arange(int(60 * FS)) / FS
    noise = np.random.default_rng(2).standard_normal((3, len(t)))
    for line, supported in ((50, True), (43, False)):
        data = 100 * np.sin(2 * np.pi * 10 * t) + 50 * np.sin(2 * np.pi * line * t) + noise
        found = recordings.check_rate(data, Settings())
        assert found["fs_supported"] == supported and found["peak_hz"] == pytest.approx(line, abs=0.2)


def test_features_of_a_known_signal():
    data, _, _ = recordings.preprocess(synthetic(FS, 300, 10.0, 60, 3), Settings())
    row = recordings.window_features(data, 30.0, 240.0, Settings())
    assert sum(k.startswith("p__") for k in row) == 9
    assert row["p__alpha_peak_hz"] == pytest.approx(10, abs=0.6)
    assert set(recordings.feature_columns(Settings().acquisition.channels)) <= set(row)
    with pytest.raises(ValueError):
        recordings.window_features(data, 200.0, 240.0, Settings())


def test_slower_settling_takes_longer():
    blocks = {s: recordings.blocks_of(recordings.preprocess(synthetic(FS, 700, 10, s, 1), Settings())[0], FS, 20) for s in (10, 400)}
    late = {s: max((b["block"] for b in v if abs(np.log2(b["rms"] / np.median([x["rms"] for x in v[-5:]]))) > 0.35), default=-1) for s, v in blocks.items()}
    assert late[400] > late[10]


def test_robust_line_ignores_a_peak():
    f = np.arange(3, 35, 0.5)
    y = 100 * f**-1.5
    y[20:24] *= 30
    slope, r2, flat = robust_lines(y[None], f)
    assert slope[0] == pytest.approx(-1.5, abs=0.02) and r2[0] > 0.99 and flat[0].argmax() in range(20, 24)


def test_higuchi_of_a_line_and_of_noise():
    x = np.stack([np.arange(400.0), np.random.default_rng(4).standard_normal(400)])
    line, noise = higuchi_slopes(x)
    assert line == pytest.approx(0, abs=1e-6) and 0.9 < noise < 1.1  # curve lengths are divided by k once


def test_settings_are_checked_and_fingerprinted():
    assert Settings().fingerprint() == Settings().fingerprint() != Settings(filtering=Filtering(low_hz=2)).fingerprint()
    for bad in (lambda: Acquisition(fs=0), lambda: Filtering(notch="maybe"), lambda: Temporal(mode="x"), lambda: Settings(mode="research"), lambda: Acquisition(channels=("a",))):
        with pytest.raises(ValueError):
            bad()
    check_model_columns(["p__rel_alpha"])
    for bad in ("e__faa", "p__phq9", "p__label"):
        with pytest.raises(ValueError):
            check_model_columns([bad])
