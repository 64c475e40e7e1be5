"""A small weighted logistic regression (Newton steps with a ridge), for calibrations."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50):
    """(coefficients, bias) of the maximum of the penalised likelihood; stops when a step is below 1e-8."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.ones(len(y)) if weight is None else weight
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ b)
        h = (a * (w * np.maximum(1e-9, p * (1 - p)))[:, None]).T @ a + ridge * np.eye(len(b))
        d = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * b)
        d *= min(1.0, 5.0 / max(1e-12, np.abs(d).max()))
        b += d
        if np.abs(d).max() < 1e-8:
            break
    return b[:-1], b[-1]
