"""Gradient steps for the models that are trained in numpy."""

from __future__ import annotations

import numpy as np


class Adam:
    """Adaptive steps for a dict of arrays, which are changed in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, slopes: dict[str, np.ndarray]) -> None:
        self.turn += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for k, g in slopes.items():
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.weights[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(self.weights[k].dtype)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
