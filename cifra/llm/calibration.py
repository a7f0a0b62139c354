"""Isotonic calibration from weighted points."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to the points: pools of neighbours that violate the order, at their
    mean x. np.interp over the knots is the calibration."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of x, sum of y
    for w, a, b in zip(weight[order].tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([w, w * a, w * b])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])
