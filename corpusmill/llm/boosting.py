"""Gradient-boosted trees on binned features, in numpy: complete trees of a fixed depth, logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """edges: for each feature the bin borders; trees: (features, bins, leaf values) of complete binary trees."""

    def __init__(self, edges: list[np.ndarray], base: float, depth: int):
        self.edges, self.base, self.depth = edges, base, depth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._raw(self.binned(x))

    def _raw(self, z: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(z), self.base), np.arange(len(z))
        for features, bins, values in self.trees:
            out += values[self._leaf(z, rows, features, bins)]
        return out

    def _leaf(self, z: np.ndarray, rows: np.ndarray, features: np.ndarray, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (z[rows, features[at]] > bins[at])
        return at - (2**self.depth - 1)

    @staticmethod
    def _histogram(node: np.ndarray, v: np.ndarray, repeated: np.ndarray, cell: np.ndarray, marks: np.ndarray, flags: np.ndarray, many: np.ndarray, count: int, bins: int) -> np.ndarray:
        """count x features x bins: sums of v over a node's rows up to each bin. cell: place of each row's bins in the node's histogram."""
        out = np.zeros((count, len(flags), bins))
        size = len(many) * bins
        out[:, many] = np.bincount((cell + node[:, None] * size).ravel(), repeated, count * size).reshape(count, len(many), bins)
        own = np.zeros((count, len(v)), np.float32)
        own[node, np.arange(len(v))] = v
        on, total = own @ marks, np.bincount(node, v, count)[:, None]
        out[:, flags, 0], out[:, flags, 1] = total - on, on
        return out.cumsum(2)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 140, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 2.0, part: float = 0.4) -> Boosted:
        """Each split takes the feature and border of the largest gain in the histograms of a random part of the rows."""
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        model = cls(edges, float(np.log(share / (1 - share))), depth)
        z = model.binned(x)
        n, width = z.shape
        raw, inner = np.full(n, model.base), 2**depth - 1
        flags = np.array([len(e) == 1 for e in edges])  # of two bins: summed by a product of matrices
        many = np.flatnonzero(~flags)
        flat, marks = z[:, many].astype(np.int64) + np.arange(len(many)) * bins, z[:, flags].astype(np.float32)
        rng = np.random.default_rng(0)
        for _ in range(rounds):
            take = np.sort(rng.permutation(n)[: max(1, int(part * n))])
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            features, borders = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
            cell, part_marks = flat[take], marks[take]
            sums = [(v[take], np.repeat(v[take], len(many))) for v in (g, h)]
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                gs, hs = (cls._histogram(at[take] - first, v, repeated, cell, part_marks, flags, many, count, bins) for v, repeated in sums)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(count, -1).argmax(1)
                split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
                features[first : first + count] = np.where(split, best // bins, 0)
                borders[first : first + count] = np.where(split, best % bins, bins)
                at = 2 * at + 1 + (z[np.arange(n), features[at]] > borders[at])
            leaf = at - inner
            values = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
            model.trees.append((features, borders, values))
            raw += values[leaf]
        return model
