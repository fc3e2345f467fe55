"""A small logistic regression with standardised features, for calibrating scores on the driver."""

from __future__ import annotations

import numpy as np


class Logistic:
    """fit() takes a bounded sample; weights give each row its share, so that class shares of the corpus can be kept."""

    def __init__(self, ridge: float = 1e-2):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Logistic:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weights is None else np.asarray(weights, float) * len(y) / np.sum(weights)
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-12] = 1.0
        z = self._design(x)
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge * len(y))
        penalty[0] = 1e-6
        for _ in range(50):
            p = self._sigmoid(z @ self.beta)
            h = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (w * (y - p)) - penalty * self.beta)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale]

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return self._sigmoid(self._design(x) @ self.beta) if len(x) else np.empty(0)
