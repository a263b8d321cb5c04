"""Logistic regression by Newton steps, for calibrating scores on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, weight: np.ndarray | None = None) -> Logistic:
    """Ridge-penalised maximum likelihood, rows counting `weight` times. One class alone, or no rows: a constant, smoothed share."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(z.shape[1])
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Logistic(mean, scale, beta[:-1], float(np.log(p / (1 - p))))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ beta)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))


def held_out_loss(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray, folds: int = 5) -> float:
    """The mean logarithmic loss of rows under models of the other folds."""
    part, total = np.arange(len(y)) % folds, 0.0
    for k in range(folds):
        rest, own = part != k, part == k
        p = np.clip(fit(x[rest], y[rest], ridge, weight=weight[rest]).score(x[own]), 1e-6, 1 - 1e-6)
        total -= float((weight[own] * (y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p))).sum())
    return total / max(1e-9, float(weight.sum()))
