"""How many components to keep."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

STRATEGIES = ("variance", "elbow", "gavish_donoho")


@dataclass(frozen=True)
class RankSelection:
    k: int
    strategy: str
    detail: str
    cumulative_variance: float

    def __str__(self) -> str:
        return f"k={self.k} by {self.strategy} ({self.detail}; {100 * self.cumulative_variance:.1f}% of variance)"


def spectrum(sigma: Sequence[float]) -> np.ndarray:
    sigma = np.asarray(sigma, float).ravel()
    if len(sigma) > 1 and (np.diff(sigma) > 1e-9 * max(sigma[0], 1.0)).any():
        raise ValueError("singular values must be descending")
    return sigma


def by_variance(sigma: Sequence[float], threshold: float = 0.9) -> int:
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    energy = spectrum(sigma) ** 2
    if not energy.sum():
        return 0
    return int((np.cumsum(energy) / energy.sum() < threshold).sum()) + 1


def by_elbow(sigma: Sequence[float]) -> int:
    """The number of values before the one that lies furthest from the chord of the scree."""
    sigma = spectrum(sigma)
    n = len(sigma)
    if n < 3 or sigma[0] == sigma[-1]:
        return n
    across = np.linspace(0, 1, n)
    up = (sigma - sigma[-1]) / (sigma[0] - sigma[-1])
    return max(1, int(np.abs(across + up - 1).argmax()))


def _threshold_factor(beta: float) -> float:
    return math.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + math.sqrt(beta * beta + 14 * beta + 1)))


def marchenko_pastur_median(beta: float) -> float:
    """Median of the Marchenko-Pastur law of aspect ratio ``beta``.

    With x = low + (high - low) sin^2(t) the density is smooth, so that a running sum over
    midpoints of t gives the distribution, and its half the median.
    """
    low, high = (1 - math.sqrt(beta)) ** 2, (1 + math.sqrt(beta)) ** 2
    n = 1 << 18
    t = (np.arange(n) + 0.5) * (math.pi / 2 / n)
    x = low + (high - low) * np.sin(t) ** 2
    weight = (np.sin(t) * np.cos(t)) ** 2 / x
    share = np.cumsum(weight)
    share /= share[-1]
    return float(np.interp(0.5, share - 0.5 * weight / weight.sum(), x))


def by_gavish_donoho(sigma: Sequence[float], n_rows: int, n_cols: int, noise_sigma: float | None = None) -> int:
    """Values over the optimal hard threshold, for known noise or by the median value."""
    sigma = spectrum(sigma)
    if not len(sigma):
        return 0
    if n_rows <= 0 or n_cols <= 0:
        raise ValueError("the matrix must have rows and columns")
    small, large = sorted((n_rows, n_cols))
    factor = _threshold_factor(small / large)
    cut = factor * math.sqrt(large) * noise_sigma if noise_sigma is not None else factor / math.sqrt(marchenko_pastur_median(small / large)) * float(np.median(sigma))
    return max(1, int((sigma > cut).sum()))


def select_rank(sigma: Sequence[float], strategy: str | int = "variance", n_rows: int | None = None, n_cols: int | None = None, variance_threshold: float = 0.9, noise_sigma: float | None = None) -> RankSelection:
    sigma = spectrum(sigma)
    if isinstance(strategy, bool):
        raise ValueError("k must be a number or a strategy")
    if isinstance(strategy, int):
        k = min(strategy, len(sigma))
        name, detail = "explicit", f"asked for {strategy}" + (f", clamped to {k}" if k != strategy else "")
    elif strategy == "variance":
        k = min(by_variance(sigma, variance_threshold), len(sigma))
        name, detail = strategy, f"threshold {variance_threshold:g}"
    elif strategy == "elbow":
        k = by_elbow(sigma)
        name, detail = strategy, "furthest from the chord"
    elif strategy == "gavish_donoho":
        if n_rows is None or n_cols is None:
            raise ValueError("gavish_donoho needs n_rows and n_cols")
        k = min(by_gavish_donoho(sigma, n_rows, n_cols, noise_sigma), len(sigma))
        name, detail = strategy, "known noise" if noise_sigma is not None else "noise from the median"
    else:
        raise ValueError(f"unknown strategy {strategy!r}; expected a number or one of {STRATEGIES}")
    energy = sigma**2
    return RankSelection(int(k), name, detail, float(energy[:k].sum() / energy.sum()) if energy.sum() else 0.0)
