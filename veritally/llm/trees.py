"""Gradient-boosted trees for two classes, in numpy: logistic loss, binned features, fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """`rounds` trees of `depth` levels; each is kept as arrays of features, thresholds and leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0):
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        n, k = binned.shape
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
            feature, threshold = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
            at = np.zeros(n, int)  # place among the nodes of the level
            for level in range(depth):
                width = 2**level
                best = np.full(width, 1e-6)
                choice: list[tuple[int, int] | None] = [None] * width
                sums = np.bincount(at, g, width), np.bincount(at, h, width)
                base = sums[0] ** 2 / (sums[1] + ridge)
                for j in range(k):
                    if not len(self.edges[j]):
                        continue
                    cell = at * BINS + binned[:, j]
                    left = [np.bincount(cell, v, width * BINS).reshape(width, BINS).cumsum(1)[:, :-1] for v in (g, h)]
                    right = sums[0][:, None] - left[0], sums[1][:, None] - left[1]
                    gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - base[:, None]
                    top = gain.argmax(1)
                    for node in np.flatnonzero(gain[np.arange(width), top] > best):
                        if top[node] < len(self.edges[j]):
                            best[node], choice[node] = gain[node, top[node]], (j, int(top[node]))
                goes_right = np.zeros(n, bool)
                for node, found in enumerate(choice):
                    if found is not None:
                        j, cut = found
                        feature[width - 1 + node], threshold[width - 1 + node] = j, self.edges[j][cut]
                        here = at == node
                        goes_right[here] = binned[here, j] > cut
                at = 2 * at + goes_right
            leaves = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
            self.trees.append((feature, threshold, leaves))
            score += leaves[at]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaves in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaves[at - (2**self.depth - 1)]
        return out
