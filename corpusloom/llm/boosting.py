"""Gradient-boosted regression trees for a yes/no label, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Additive trees of fixed depth under logistic loss; splits are taken from histograms of gradients."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 4.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.edges: list[np.ndarray] = []
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
        b = self._binned(x)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = np.log(p / (1 - p))
        f = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q) + 1e-9
            at = np.zeros(len(y), np.int64)  # node of each row, in heap order
            column, bound = np.zeros(inner, np.int64), np.full(inner, BINS)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                best = np.zeros(nodes)
                for j in range(x.shape[1]):
                    slot = (at - first) * BINS + b[:, j]
                    gl = np.cumsum(np.bincount(slot, g, nodes * BINS).reshape(nodes, BINS), 1)
                    hl = np.cumsum(np.bincount(slot, h, nodes * BINS).reshape(nodes, BINS), 1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(nodes), k] > best + 1e-12
                    best = np.where(better, gain[np.arange(nodes), k], best)
                    here = first + np.flatnonzero(better)
                    column[here], bound[here] = j, k[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), column[at]] > bound[at])
            leaf = at - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            f += value[leaf]
            self.fitted.append((column, bound, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x) if len(x) else np.zeros((0, len(self.edges)), np.int64)
        out, rows, inner = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for column, bound, value in self.fitted:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, column[at]] > bound[at])
            out += value[at - inner]
        return out
