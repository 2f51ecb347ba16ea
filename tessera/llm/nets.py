"""Small numpy helpers for the trained models."""

from __future__ import annotations

import numpy as np


class Adam:
    """Adam steps over named arrays, in place."""

    def __init__(self, rate: float = 0.003):
        self.rate, self.t = rate, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m = self.m.setdefault(k, np.zeros_like(params[k]))
            v = self.v.setdefault(k, np.zeros_like(params[k]))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(params[k].dtype)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, summed values) for a scatter into ``table``."""
    keys, inverse = np.unique(rows, return_inverse=True)
    out = np.zeros((len(keys), values.shape[1]), table.dtype)
    np.add.at(out, inverse, values.astype(table.dtype))
    return keys, out
