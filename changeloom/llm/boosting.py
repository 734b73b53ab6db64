"""Gradient-boosted trees and isotonic calibration for a bounded number of dense rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Forest(NamedTuple):
    """Complete trees of one depth: in each level's nodes, rows with ``x[feature] > threshold`` go right."""

    start: float
    feature: np.ndarray    # [tree, inner node]
    threshold: np.ndarray  # [tree, inner node]
    leaf: np.ndarray       # [tree, leaf]
    steps_x: np.ndarray    # calibration: log odds ...
    steps_y: np.ndarray    # ... and their probability


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.concatenate((np.quantile(c, quantiles), [0.0] if (c > 0).any() and (c <= 0).any() else [])))
            for c in x.T]


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0,
         least: float = 1.0) -> Forest:
    """Trees for log odds of ``y`` by Newton steps on binned features."""
    n, width = x.shape
    cuts = _cuts(x)
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    odds = np.full(n, start)
    inner = 2 ** depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            size, base = 2 ** level, 2 ** level - 1
            best, gain = np.zeros((size, 2), np.int64), np.full(size, 1e-9)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = node * (BINS + 2) + binned[:, f]
                g = np.bincount(key, gradient, size * (BINS + 2)).reshape(size, -1).cumsum(1)
                h = np.bincount(key, weight, size * (BINS + 2)).reshape(size, -1).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                found = g ** 2 / (h + ridge) + gr ** 2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                found = np.where((h >= least) & (hr >= least), found, 0)[:, :len(cuts[f])]
                at = found.argmax(1)
                value = found[np.arange(size), at]
                better = value > gain
                gain[better] = value[better]
                best[better] = np.stack((np.full(size, f), at), axis=1)[better]
            for i in range(size):
                if gain[i] > 1e-9:
                    feature[base + i], threshold[base + i] = best[i, 0], cuts[best[i, 0]][best[i, 1]]
            node = 2 * node + (x[np.arange(n), feature[base + node]] > threshold[base + node])
        leaf = -rate * np.bincount(node, gradient, 2 ** depth) / (np.bincount(node, weight, 2 ** depth) + ridge)
        odds += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(start, np.array(features), np.array(thresholds), np.array(leaves), np.zeros(0), np.zeros(0))


def log_odds(forest: Forest, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), forest.start)
    rows = np.arange(len(x))
    depth = int(np.log2(forest.leaf.shape[1])) if forest.leaf.size else 0
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            base = 2 ** level - 1
            node = 2 * node + (x[rows, feature[base + node]] > threshold[base + node])
        out += leaf[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone steps (score, probability) closest to ``y``: neighbours out of order are pooled."""
    values, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for v, w, t in zip(values, weight, total):
        blocks.append([v, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, w2, t2 = blocks.pop()
            blocks[-1][1] += w2
            blocks[-1][2] += t2
    # Pulled a little towards the middle, so that no score is exactly 0 or 1.
    return np.array([b[0] for b in blocks]), np.array([(b[2] + 0.1) / (b[1] + 0.2) for b in blocks])


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees on all rows, calibrated on predictions for rows that the trees at hand hadn't seen (two folds).

    Without rows, or with one class only, the share of ones (one half without rows) is predicted for every row.
    """
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 0.1) / (len(y) + 0.2)
        none = np.zeros((0, 0))
        return Forest(0.0, none, none, none, np.zeros(1), np.array([share]))
    fold = np.arange(len(y)) % 2
    seen = np.zeros(len(y))
    for k in (0, 1):
        other = fold != k
        if y[other].min() == y[other].max():
            seen[~other] = 0
        else:
            seen[~other] = log_odds(grow(x[other], y[other]), x[~other])
    steps = isotonic(seen, y)
    return grow(x, y)._replace(steps_x=steps[0], steps_y=steps[1])


def probability(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Calibrated probability; between two steps it is interpolated, so that it still tells rows apart."""
    return np.interp(log_odds(forest, x), forest.steps_x, forest.steps_y)
