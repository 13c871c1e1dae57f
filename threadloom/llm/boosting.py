"""Histogram gradient-boosted trees for two classes, in numpy.

fit() bins each feature at its quantiles and grows trees of full depth level by level from
gradient histograms. The model is a few flat arrays, and predict() walks all rows through all
trees at once, a level at a time. Fitting is for a bounded sample on one machine; predicting
is for the batches of a Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    #: Feature and threshold of inner node i of each tree; its children are 2i+1 and 2i+2.
    feature: np.ndarray
    threshold: np.ndarray
    #: Value of each leaf of each tree, in log odds.
    leaf: np.ndarray
    base: float
    #: Calibration: probability = 1 / (1 + exp(-(slope * log odds + offset))).
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), step):
            part = x[at : at + step]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))) if len(self.feature) else ():
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[at : at + step] = self.base + (self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(self.feature) else 0)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Trees:
    """x: rows by features, finite; y: 0 or 1. A table of one class or no rows gives its (smoothed) share."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), float(np.log(share / (1 - share))))
    if n < 2 * least or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)
    score = np.full(n, model.base)
    feature, threshold, leaf = [], [], []
    slots = np.arange(width) * BINS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        tree_f, tree_t, node = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf), np.zeros(n, int)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (width * BINS) + slots + binned).ravel()
            size = nodes * width * BINS
            sums = [np.bincount(flat, np.repeat(v, width), size).reshape(nodes, width, BINS) for v in (g, h, np.ones(n))]
            left = [np.cumsum(s, 2) for s in sums]
            whole = [s[:, :1].sum(2, keepdims=True) for s in sums]
            gain = left[0] ** 2 / (left[1] + l2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
            for i in range(nodes):
                j, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    tree_f[first + i], tree_t[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), tree_f[node]] > tree_t[node])
        at = node - (2**depth - 1)
        value = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        score += value[at]
        feature.append(tree_f), threshold.append(tree_t), leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), model.base)


def calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **how) -> tuple[Trees, np.ndarray]:
    """Trees fitted to all rows, with log odds calibrated on scores of rows that were held out
    (fold: 0, 1 or 2 by row). Returns them and the held-out probabilities."""
    model, held = fit(x, y, **how), np.zeros(len(y))
    for k in range(3):
        rest, part = fold != k, fold == k
        if part.any():
            held[part] = fit(x[rest], y[rest], **how).raw(x[part]) if rest.any() else model.raw(x[part])
    a, b = 1.0, 0.0
    for _ in range(25 if len(y) and y.min() != y.max() else 0):  # Newton steps on the two weights
        p = 1 / (1 + np.exp(-np.clip(a * held + b, -30, 30)))
        d, w = y - p, p * (1 - p) + 1e-9
        grad = np.array([(d * held).sum() - 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(w * held * held).sum() + 1e-3, (w * held).sum()], [(w * held).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = float(np.clip(a + step[0], 0.05, 20)), float(np.clip(b + step[1], -20, 20))
    model.slope, model.offset = a, b
    return model, 1 / (1 + np.exp(-np.clip(a * held + b, -30, 30)))
