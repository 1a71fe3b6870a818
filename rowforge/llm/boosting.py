"""Gradient-boosted trees for two classes: logistic loss, histograms of quantile bins, trees of equal depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``rounds`` trees of ``depth`` levels over at most ``bins`` bins a feature; fitting is deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 3.0):
        n, d = x.shape
        self.depth, self.edges = depth, [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = self._bin(x)
        mean = (y.sum() + 0.5) / (n + 1)
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        score = np.full(n, self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            features, cuts = [], []
            for level in range(depth):
                width = 1 << level
                best = np.zeros(width)
                feature, cut = np.zeros(width, np.int64), np.full(width, bins, np.int64)  # all to the left
                for j in range(d):
                    key = node * bins + binned[:, j]
                    g = np.bincount(key, gradient, width * bins).reshape(width, bins)
                    h = np.bincount(key, curvature, width * bins).reshape(width, bins)
                    left_g, left_h = np.cumsum(g, 1), np.cumsum(h, 1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
                    few = least / 4
                    gain = np.where((left_h >= few) & (right_h >= few), gain, 0)
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    better = value > best + 1e-9
                    best, feature, cut = np.where(better, value, best), np.where(better, j, feature), np.where(better, at, cut)
                features.append(feature)
                cuts.append(cut)
                node = node * 2 + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << depth
            value = rate * np.bincount(node, gradient, leaves) / (np.bincount(node, curvature, leaves) + penalty)
            score += value[node]
            self.trees.append((features, cuts, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        binned, rows = self._bin(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for features, cuts, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts, strict=True):
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            score += value[node]
        return score
