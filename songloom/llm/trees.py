"""Gradient-boosted trees over binned features, flattened into arrays.

All trees have the same depth, so node k's children are nodes 2k + 1 and 2k + 2 and a forest
is three arrays. Scoring walks all rows through all trees together, one level at a time.
Fitting is for a bounded sample: features are cut at quantiles, a level's histograms of
gradients come from one count, and nothing in it is random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    above: np.ndarray  # (trees, inner nodes): a value above this goes right
    value: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees:
            return out
        which = np.arange(trees)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            while node[0, 0] < inner:
                right = part[rows, self.feature[which, node]] > self.above[which, node]
                node = 2 * node + 1 + right
            out[at : at + 2048] += self.value[which, node - inner].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -50, 50)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, least: float = 4.0, ridge: float = 1.0,
) -> Forest:
    """Logistic boosting. Without rows, or with one label only, all scores are the prior."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        trees = 0
    feature = np.zeros((trees, inner), np.int64)
    above = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if not trees:
        return Forest(base, feature, above, value)

    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], axis=1)
    cells = binned + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * width * bins + cells).ravel()
            size = count * width * bins
            g = np.bincount(place, np.repeat(gradient, width), size).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, width), size).reshape(count, width, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], above[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > above[t, node])
        leaf = node - inner
        total_g = np.bincount(leaf, gradient, leaves)
        total_h = np.bincount(leaf, weight, leaves)
        value[t] = rate * total_g / (total_h + ridge)
        margin += value[t][leaf]
    return Forest(base, feature, above, value)
