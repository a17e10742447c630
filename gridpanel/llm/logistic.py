"""A small logistic regression for bounded training samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights (intercept last) by Newton steps to convergence; without rows or with one class only the intercept is fitted."""
    n, k = x.shape
    center = x.mean(0) if n else np.zeros(k)
    scale = x.std(0) if n else np.ones(k)
    scale = np.where(scale > 1e-12, scale, 1.0)
    w = np.zeros(k + 1)
    if not n or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else 0.0
        return center, scale, w
    z = np.hstack(((x - center) / scale, np.ones((n, 1))))
    weight = np.ones(n) if weight is None else weight
    penalty = np.full(k + 1, ridge * weight.sum() / 100)
    penalty[-1] = 0
    for _ in range(100):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (y - p)) - penalty * w
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty + 1e-9), gradient)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w
