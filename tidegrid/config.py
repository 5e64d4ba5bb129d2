"""Frozen settings of an analysis, with their checks and a fingerprint."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

# The band edges and thresholds that results must agree with, here and as the defaults of the classes below.
PROFILE_BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma_low": (30.0, 40.0)}
TOTAL_BAND = (1.0, 40.0)
OCULAR_BAND = (0.5, 3.0)
MUSCLE_BAND = (20.0, 40.0)
PRIMARY_FEATURES = ("rel_delta", "rel_theta", "rel_alpha", "rel_beta", "spec_entropy", "alpha_peak_hz", "aperiodic_slope", "hjorth_mobility", "hjorth_complexity")
CLINICAL_TOKENS = ("phq", "gad", "psqi", "ctq", "les", "ssrs")
TINY = 1e-30
JS_FLOOR = 1e-12


def _require(ok: bool, said: str) -> None:
    if not ok:
        raise ValueError(said)


@dataclass(frozen=True)
class Acquisition:
    fs: float = 250.0
    channels: tuple[str, ...] = ("Fp1", "Fpz", "Fp2")
    adc_bits: int = 24
    container_bits: int = 32
    tasks: tuple[str, ...] = ("still", "unspecified")
    max_seconds: float = 7200.0
    line_hz: float = 50.0
    mains_hz: tuple[float, ...] = (50.0, 60.0)
    mains_tolerance_hz: float = 0.50
    mains_prominence: float = 0.30

    def __post_init__(self) -> None:
        _require(self.fs > 0, "the sampling rate must be positive")
        _require(len(self.channels) == 3 and len(set(self.channels)) == 3, "three distinct channels are needed")
        _require(0 < self.adc_bits <= self.container_bits, "the converter can't have more bits than its container")


@dataclass(frozen=True)
class Filtering:
    low_hz: float = 1.0
    high_hz: float = 40.0
    order: int = 4
    notch: str = "auto"
    notch_q: float = 30.0
    notch_ratio: float = 0.02
    trim_seconds: float = 2.0
    demean: str = "after"

    def __post_init__(self) -> None:
        _require(0 < self.low_hz < self.high_hz, "the pass band must be ascending and positive")
        _require(self.notch in ("auto", "always", "never"), "notch is auto, always or never")
        _require(self.demean in ("after", "before", "none"), "demean is after, before or none")


@dataclass(frozen=True)
class Temporal:
    mode: str = "derived"
    block_seconds: float = 20.0
    min_seconds: float = 600.0
    min_skip: float = 30.0
    max_skip: float = 420.0
    target: float = 240.0
    max_window: float = 480.0
    n_windows: int = 3
    quantile: float = 0.80
    tol_log2: float = 0.35
    tol_js: float = 0.15
    terminal_blocks: int = 5
    reference: str = "cohort"
    fixed_skip: float = 30.0
    fixed_window: float = 240.0

    def __post_init__(self) -> None:
        _require(self.mode in ("derived", "fixed"), "the temporal mode is derived or fixed")
        _require(self.reference in ("cohort", "self"), "the settling reference is cohort or self")
        _require(self.fixed_skip >= 0 and self.fixed_window > 0, "the fixed window must be positive")
        _require(0 <= self.min_skip <= self.max_skip, "the skip bounds must be ascending")
        _require(0 < self.quantile <= 1, "the quantile lies in (0, 1]")
        _require(0 < self.target <= self.max_window and self.n_windows >= 1, "the windows must be positive")


@dataclass(frozen=True)
class Epoching:
    seconds: float = 4.0
    overlap: float = 0.0
    welch_seconds: float = 2.0
    aggregate: str = "median"
    p2p: tuple[float, float] = (0.2, 5.0)
    jump: float = 8.0
    low_share: float = 2.5
    max_rejected: float = 0.5
    min_good: int = 30

    def __post_init__(self) -> None:
        _require(self.seconds > 0 and 0 <= self.overlap < 1, "epochs need a positive length and an overlap below one")
        _require(self.aggregate in ("median", "mean"), "the aggregate is median or mean")


@dataclass(frozen=True)
class Quality:
    line: float = 0.25
    ocular: float = 0.80
    muscle: float = 0.60
    frozen: float = 0.20
    saturation: float = 1e-4
    min_corr: float = -0.50
    nonstationarity: float = 1.00
    mad_z: float = 4.0
    frozen_thresholds: bool = False
    use_nonstationarity: bool = True
    outliers: tuple[str, ...] = ("line_ratio_post", "ocular_index", "muscle_ratio", "nonstationarity_cv", "log_rms")

    def __post_init__(self) -> None:
        _require(len(set(self.outliers)) == len(self.outliers), "an outlier metric is named twice")

    @property
    def cohort_metrics(self) -> tuple[str, ...]:
        """Metrics whose outliers in the cohort fail; nonstationarity only where it is in use."""
        return tuple(m for m in self.outliers if self.use_nonstationarity or m != "nonstationarity_cv")


@dataclass(frozen=True)
class Inference:
    fdr: float = 0.05
    n_boot: int = 2000
    outer_folds: int = 5
    outer_repeats: int = 20
    inner_folds: int = 5
    grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    n_permutations: int = 200
    matched_repeats: int = 5
    threshold: float = 0.5
    seed: int = 20240517
    min_subjects: int = 20


@dataclass(frozen=True)
class Settings:
    acquisition: Acquisition = field(default_factory=Acquisition)
    filtering: Filtering = field(default_factory=Filtering)
    temporal: Temporal = field(default_factory=Temporal)
    epochs: Epoching = field(default_factory=Epoching)
    quality: Quality = field(default_factory=Quality)
    inference: Inference = field(default_factory=Inference)
    mode: str = "integration"
    expected_ids: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _require(self.mode in ("integration", "research"), "the mode is integration or research")
        _require(self.filtering.high_hz < self.acquisition.fs / 2, "the pass band must end below half the sampling rate")
        _require(self.mode != "research" or self.quality.frozen_thresholds, "research mode needs frozen thresholds")

    def fingerprint(self) -> str:
        """First 16 hex digits of the SHA-256 of the sorted settings."""
        plain = json.dumps(asdict(self), sort_keys=True, default=lambda x: "inf" if x == math.inf else str(x))
        return hashlib.sha256(plain.encode()).hexdigest()[:16]


def check_model_columns(columns: list[str]) -> None:
    """Only confirmatory features may reach a model: no clinical scales, no labels."""
    for c in columns:
        _require(c.startswith("p__"), f"{c} is no confirmatory feature")
        _require(not any(t in c.lower() for t in CLINICAL_TOKENS), f"{c} looks like a clinical scale")
        _require("label" not in c.lower(), f"{c} looks like a label")


def blocked_reasons(n: int, n_classes: int, smallest_class: int, mode: str, least: int = 20) -> list[str]:
    """Why inference may not run; empty when it may."""
    found = []
    if mode == "integration":
        found.append("integration mode")
    if n < least:
        found.append("too few subjects")
    if n_classes < 2:
        found.append("one class only")
    if smallest_class < least:
        found.append("smallest class too small")
    return found
