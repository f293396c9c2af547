"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Trees:
    """Complete binary trees of one depth; row t of every array is a tree, its nodes in heap order."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows, all rows walking down a tree together."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def train(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least: int = 10,
) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    Without rows, or with one class only, the prior alone remains (one half without rows).
    """
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    prior = (y.sum() + 0.5) / (n + 1.0)
    model = Trees(float(np.log(prior / (1 - prior))), *(np.zeros((0, k)) for k in (inner, inner, leaves)), depth)
    model.feature = model.feature.astype(np.int64)
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = codes + np.arange(width) * bins
    allowed = np.zeros((width, bins), bool)
    for f, e in enumerate(edges):
        allowed[f, : len(e)] = True
    margin = np.full(n, model.base)
    kept = []
    for _ in range(trees):
        p = sigmoid(margin)
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first) * (width * bins))[:, None] + flat
            shape = (count, width, bins)
            size = count * width * bins
            sums = [np.bincount(at.ravel(), np.repeat(v, width), size).reshape(shape) for v in (gradient, hessian)]
            number = np.bincount(at.ravel(), minlength=size).reshape(shape)
            g, h, c = (np.cumsum(v, axis=2) for v in (*sums, number))
            all_g, all_h, all_c = g[..., -1:], h[..., -1:], c[..., -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[~(allowed & (c >= least) & (all_c - c >= least))] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            found = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            f, b = np.divmod(best, bins)
            cut = np.array([edges[i][min(j, len(edges[i]) - 1)] if ok else np.inf for i, j, ok in zip(f, b, found)])
            feature[first : first + count] = np.where(found, f, 0)
            threshold[first : first + count] = cut
            own = node - first
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[own])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        value = -rate * g / (h + l2)
        margin += value[leaf]
        kept.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(v) for v in zip(*kept))
    return model
