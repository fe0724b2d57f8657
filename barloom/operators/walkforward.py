"""What a rolling model learns anew at each refit, from its own window only: which factors it takes, and how its signal trades.

Factors are chosen by their correlation with the target and with one another. The sums that correlations need are kept as
two running sums of products, up to the window's start and up to its end; their difference is the window's, so moving on by
a few bars costs these bars' products and not the window's.
"""

from __future__ import annotations

import numpy as np

from ..config import ModelSettings
from .composite import threshold_grid
from .pairs import correlation, moments


class WindowMoments:
    """Moments of the columns of x (NaN: missing) over windows of rows that move forward."""

    def __init__(self, x: np.ndarray):
        with np.errstate(all="ignore"):
            have = ~np.isnan(x)
            mean = np.where(have, x, 0.0).sum(0) / np.maximum(have.sum(0), 1)
        self.x = x - mean  # correlations stay, and little is lost to cancellation
        self.at = [0, 0]
        self.sums = [np.zeros((6, x.shape[1], x.shape[1])) for _ in range(2)]

    def correlations(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Correlations of all columns over rows [low, high), and the numbers of rows that both have."""
        for side, to in enumerate((low, high)):
            if to < self.at[side]:
                raise ValueError("windows move forward")
            rows = self.x[self.at[side] : to]
            if len(rows):
                self.sums[side] = self.sums[side] + moments(rows, rows)
                self.at[side] = to
        t = self.sums[1] - self.sums[0]
        return correlation(t, self.sums[1]), t[0]


def choose(r: np.ndarray, n: np.ndarray, s: ModelSettings) -> list[int]:
    """The columns to take, the last one being the target: by absolute correlation with it, each little correlated with those before."""
    k = len(r) - 1
    score = np.abs(r[:k, k])
    score = np.where(n[:k, k] >= s.min_samples, score, np.nan)
    ranked = [i for i in np.lexsort((np.arange(k), -score)) if not np.isnan(score[i])][: max(s.best, s.best * max(1, s.candidate_multiplier))]
    taken: list[int] = []
    for i in ranked:
        if len(taken) >= s.best:
            break
        near = np.abs(r[i, taken])
        if not (near >= s.max_feature_corr).any():
            taken.append(int(i))
    return taken


def traded(p: np.ndarray, min_edge: float, min_probability: float, allowed: np.ndarray) -> np.ndarray:
    """1, -1 or 0 for each row of probabilities (down, flat, up)."""
    edge, sure = p[:, 2] - p[:, 0], np.maximum(p[:, 0], p[:, 2]) >= min_probability
    return np.where(allowed & sure, np.where(edge >= min_edge, 1.0, np.where(edge <= -min_edge, -1.0, 0.0)), 0.0)


def calibrate(p: np.ndarray, ahead: np.ndarray, allowed: np.ndarray, s: ModelSettings) -> tuple[float, float, float]:
    """(min_edge, min_probability, direction) that would have earned most on the rows: mean over deviation, of enough trades; the first of equals."""
    best, most = (s.min_edge, s.min_probability), -np.inf
    for e, c in threshold_grid(s) if s.calibrate_thresholds else ():
        signal = traded(p, e, c, allowed)
        gain = signal * ahead
        gain = gain[np.isfinite(gain)]
        if (signal != 0).sum() >= max(1, s.threshold_min_trades) and len(gain):
            spread = gain.std()
            score = gain.mean() / spread if spread > 0 else gain.mean()
            if score > most:
                best, most = (e, c), score
    return *best, way(traded(p, *best, allowed), ahead) if s.calibrate_direction else 1.0


def way(signal: np.ndarray, ahead: np.ndarray) -> float:
    """-1 if the signals would have earned more the other way round, else 1."""
    gain = signal * ahead
    return -1.0 if gain[np.isfinite(gain)].sum() < 0 else 1.0


def mean_of(signal: np.ndarray) -> np.ndarray:
    """Each row's mean over the columns that are there; NaN where none is."""
    have = ~np.isnan(signal)
    with np.errstate(all="ignore"):
        return np.where(have, signal, 0.0).sum(1) / np.where(have.any(1), have.sum(1), np.nan)


def age_weight(age: np.ndarray, half_life: float | None, floor: float = 0.25) -> np.ndarray:
    """Half for every half_life bars of age, `floor` at least, mean 1."""
    if half_life is None or not len(age):
        return np.ones(len(age))
    w = np.maximum(floor, 0.5 ** (age / half_life))
    return w / w.mean()
