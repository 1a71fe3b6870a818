"""Isotonic calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np


class Isotonic:
    """The non-decreasing step fit of labels to scores (pool adjacent violators), read off linearly between its steps."""

    def __init__(self, score: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None):
        weight = np.ones(len(score)) if weight is None else weight
        keep = weight > 0
        score, label, weight = score[keep], label[keep], weight[keep]
        at, inverse = np.unique(score, return_inverse=True)
        w = np.bincount(inverse, weight, len(at))
        y = np.bincount(inverse, weight * label, len(at)) / w
        x = np.bincount(inverse, weight * score, len(at)) / w
        blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
        for wi, yi, xi in zip(w.tolist(), y.tolist(), x.tolist(), strict=True):
            blocks.append([wi, wi * yi, wi * xi])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[0] for b in blocks])
        self.y = np.array([b[1] / b[0] for b in blocks])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
