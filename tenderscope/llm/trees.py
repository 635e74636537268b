"""Histogram decision trees on bounded training sets, flattened into arrays.

All trees have the same depth; node k has the children 2k+1 and 2k+2, so a whole
ensemble is three arrays (feature, threshold, leaf value) and a batch of rows
walks all trees level by level with array indexing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``threshold`` [tree, inner node], ``value`` [tree, leaf]."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values over the trees, plus the base."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, the values between which splits are tried."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


class Grower:
    """Grows trees on one binned training matrix."""

    def __init__(self, x: np.ndarray, depth: int, bins: int = 64):
        self.depth, self.bins = depth, bins
        self.edges = _edges(x, bins)
        # bin b: value <= edge b
        self.binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def grow(self, gradient: np.ndarray, weight: np.ndarray, l2: float, least: float, columns=None):
        """One tree fitted to ``-gradient / weight``: (feature, threshold, leaf values, leaf of each row)."""
        n, f = self.binned.shape
        feature = np.zeros(2 ** self.depth - 1, np.int64)
        threshold = np.full(2 ** self.depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            nodes = 2 ** level
            cells = ((node[:, None] * f + np.arange(f)) * self.bins + self.binned).ravel()
            g = np.bincount(cells, np.repeat(gradient, f), nodes * f * self.bins).reshape(nodes, f, self.bins)
            h = np.bincount(cells, np.repeat(weight, f), nodes * f * self.bins).reshape(nodes, f, self.bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gt ** 2 / (ht + l2)
            gain[~((hl >= least) & (hr >= least)) | ~np.isfinite(gain)] = 0.0
            for k, e in enumerate(self.edges):
                gain[:, k, len(e):] = 0.0
            if columns is not None:
                gain[:, np.setdiff1d(np.arange(f), columns(f)), :] = 0.0
            best = gain.reshape(nodes, -1).argmax(1)
            good = gain.reshape(nodes, -1).max(1) > 1e-9
            split_f, split_b = best // self.bins, best % self.bins
            at = nodes - 1 + np.arange(nodes)
            feature[at] = np.where(good, split_f, 0)
            threshold[at[good]] = [self.edges[a][b] for a, b in zip(split_f[good], split_b[good])]
            right = good[node] & (self.binned[np.arange(n), split_f[node]] > split_b[node])
            node = 2 * node + right
        leaves = 2 ** self.depth
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        value = np.divide(-g, h + l2, out=np.zeros(leaves), where=h + l2 > 0)
        return feature, threshold, value, node


def _constant(value: float) -> Forest:
    return Forest(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), value)


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, l2: float = 1.0,
            least: float = 5.0) -> Forest:
    """Gradient-boosted trees for the log loss; ``raw`` gives log odds."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return _constant(base)
    grower, score, grown = Grower(x, depth), np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        feature, threshold, value, leaf = grower.grow(p - y, p * (1 - p), l2, least / 10)
        grown.append((feature, threshold, rate * value))
        score += rate * value[leaf]
    return Forest(*(np.stack(a) for a in zip(*grown)), base)


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 8, seed: int = 1) -> Forest:
    """Bagged trees on random feature subsets; ``raw`` is the mean share of label 1 in the leaves."""
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)
    rng, grower, grown = np.random.default_rng(seed), Grower(x, depth, 32), []
    def columns(f):
        return rng.choice(f, max(1, int(np.sqrt(f)) + 1), replace=False)
    share = len(y) / (2 * np.maximum(np.bincount(y.astype(int), minlength=2), 1))  # both labels weigh the same
    for _ in range(trees):
        weight = rng.multinomial(len(y), np.full(len(y), 1 / len(y))) * share[y.astype(int)]
        feature, threshold, value, _ = grower.grow(-weight * y, weight, 0.0, 1.0, columns)
        grown.append((feature, threshold, value / trees))
    return Forest(*(np.stack(a) for a in zip(*grown)))
