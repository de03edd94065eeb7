"""FTRL-proximal logistic regression over hashed binary features: per-coordinate rates, L1 sparsity."""

from __future__ import annotations

import math

import numpy as np


class Ftrl:
    """One pass over a row updates only its features' coordinates. A row is an array of distinct feature numbers."""

    def __init__(self, bits: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, row: np.ndarray, label: float) -> None:
        """The features of a row and the bias, which no L1 holds back, share one gradient."""
        b, z, n = self.bias, self.z[row], self.n[row]
        root, bias_root = np.sqrt(n), math.sqrt(self.n[b])
        w = np.maximum(np.abs(z) - self.l1, 0.0)
        w *= np.sign(z) * -self.alpha / (root + (self.beta + self.alpha * self.l2))
        bias = -self.z[b] * self.alpha / (bias_root + self.beta + self.alpha * self.l2)
        g = 1 / (1 + math.exp(-min(max(float(w.sum() + bias), -35.0), 35.0))) - label
        n += g * g
        w *= (np.sqrt(n) - root) / self.alpha
        self.z[row] = z + g - w
        self.n[row] = n
        self.n[b] += g * g
        self.z[b] += g - (math.sqrt(self.n[b]) - bias_root) / self.alpha * bias

    def fit(self, rows: list[np.ndarray], labels: list[float], epochs: int = 2, seed: int = 7) -> Ftrl:
        """Passes over the rows in seeded orders, one row after another; the rows are read where they are."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.learn(rows[i], labels[i])
        return self

    def weights(self) -> np.ndarray:
        """All weights, the bias last; most are exactly 0."""
        return self._weights(np.arange(len(self.z))).astype(np.float32)


def margin(row: np.ndarray, weights: np.ndarray) -> float:
    """The weighted sum of a row's distinct features, and the bias; row may repeat features."""
    used = row[weights[row] != 0]
    return float(weights[np.unique(used)].sum(dtype=np.float64) + weights[-1])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))
