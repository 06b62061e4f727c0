"""Gradient-boosted trees for two classes, on a feature matrix of bounded size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees of equal depth, each as the features and thresholds of its inner nodes (in heap order) and the values of its leaves."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Trees by second-order logistic boosting over histograms of at most BINS quantiles a feature. Ties take the first feature and the lowest threshold; a node without gain sends all rows left."""
    n, width = x.shape
    share = np.clip(np.average(y, weights=weight) if n else 0.5, 1e-6, 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if not n:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    slot = binned + np.arange(width) * BINS
    score = np.full(n, model.base)
    inner, bottom = 2**depth - 1, 2**depth
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = weight * (p - y), weight * p * (1 - p)
        feature, threshold, at_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * BINS) + slot).ravel()
            sums = [np.bincount(place, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(axis=2) for v in (gradient, curve)]
            (left_g, left_h), (all_g, all_h) = sums, [s[:, :1, -1:] for s in sums]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                j, cut = divmod(b, BINS)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[first + k], threshold[first + k], at_bin[first + k] = j, edges[j][cut], cut
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > at_bin[node])
        leaf_of = node - inner
        g, h = (np.bincount(leaf_of, v, bottom) for v in (gradient, curve))
        leaf = -rate * g / (h + ridge)
        score += leaf[leaf_of]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(leaf)
    return model
