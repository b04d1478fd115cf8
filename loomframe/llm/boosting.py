"""Gradient-boosted trees: a histogram trainer for bounded samples, flat numpy node arrays for scoring.

The trainer runs on the driver over a bounded sample (the callers document the bound); scoring needs only the
arrays, which are a few kB, or the SQL expression made from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All trees in four parallel arrays.  A leaf points to itself, so every row takes ``depth`` equal steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    names: list[str] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x; NaN goes left, as does a value equal to the threshold."""
        x = np.nan_to_num(np.asarray(x, dtype=np.float64), nan=-np.inf)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))

    def sql(self, columns: list[str]) -> str:
        """The log-odds as a SQL expression over ``columns``, one nested CASE for each tree."""

        def node(at: int) -> str:
            if self.left[at] == at:
                return f"{float(self.value[at])!r}D"
            return f"CASE WHEN {columns[self.feature[at]]} <= {float(self.threshold[at])!r}D THEN {node(self.left[at])} ELSE {node(self.right[at])} END"

        return " + ".join([f"{float(self.base)!r}D", *(f"({node(r)})" for r in self.roots)])


def constant(base: float, n_features: int = 1) -> Forest:
    none = np.zeros(0)
    return Forest(none.astype(int), none, none.astype(int), none.astype(int), none, none.astype(int), 0, base, [])


def _bins(x: np.ndarray, n_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        seen = np.unique(column)
        if len(seen) > n_bins:
            seen = np.unique(np.quantile(column, np.linspace(0, 1, n_bins + 1)))
        out.append((seen[1:] + seen[:-1]) / 2)
    return out


def fit(x, y, *, n_trees=60, depth=3, rate=0.2, l2=1.0, min_child=5.0, n_bins=48, monotone=None, names=()) -> Forest:
    """Newton boosting of the logistic loss.

    monotone: +1, 0 or -1 for each feature; a split that would break the order is refused, and the children of an
    accepted one stay on their side of the midpoint, so the whole forest is monotone in that feature.
    A sample with one class, or none, gives a constant.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return constant(4.0 if not len(y) or y[0] else -4.0)
    monotone = np.zeros(x.shape[1], dtype=int) if monotone is None else np.asarray(monotone)
    cuts = _bins(x, n_bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(feature)
        weight = lambda a, b: float(np.clip(-a / (b + l2), low, high))
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
        gs, hs = g[rows].sum(), h[rows].sum()
        own = weight(gs, hs)
        for a, v in ((feature, 0), (threshold, 0.0), (left, at), (right, at), (value, rate * own)):
            a.append(v)
        best = (1e-6, None)
        if level:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = gain_of(gl, hl, wl) + gain_of(gs - gl, hs - hl, wr) - gain_of(gs, hs, own)
                gain[(hl < min_child * 0.1) | (hs - hl < min_child * 0.1) | (monotone[f] * (wr - wl) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1]:
            f, k, wl, wr = best[1]
            mid = (wl + wr) / 2
            lows, highs = ((low, mid), (mid, high)) if monotone[f] > 0 else ((mid, high), (low, mid)) if monotone[f] < 0 else ((low, high), (low, high))
            goes = binned[rows, f] <= k
            feature[at], threshold[at], value[at] = f, float(cuts[f][k]), 0.0
            left[at] = grow(rows[goes], g, h, level - 1, *lows)
            right[at] = grow(rows[~goes], g, h, level - 1, *highs)
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(feature)
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
        tree = Forest(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array([first]), depth, 0.0)
        margin += tree.raw(x)
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base, list(names))
