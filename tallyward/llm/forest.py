"""A small random forest on numpy arrays: fitted on a bounded sample, carried to the tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as arrays (trees, nodes): the feature asked for (-1 at a leaf), its threshold, the child for values up to it (the other follows), the share of ones."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    share: np.ndarray

    def each(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the share of ones at the leaf of each tree that a row of x comes to."""
        out = np.zeros((len(self.feature), len(x)))
        rows = np.arange(len(x))
        for k, (f, t, c, s) in enumerate(zip(self.feature, self.threshold, self.child, self.share, strict=True)):
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                i = rows[inner]
                at[i] = c[at[i]] + (x[i, f[at[i]]] > t[at[i]])
            out[k] = s[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of ones over the trees, for each row of x."""
        return self.each(x).mean(0)


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    """(Gini gain, feature, threshold) of the best cut; gain 0 if none."""
    best, n, ones = (0.0, -1, 0.0), len(y), y.sum()
    base = ones * (n - ones) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, k = x[order, f], np.cumsum(y[order])[:-1]
        left = np.arange(1, n)
        gain = base - k * (left - k) / left - (ones - k) * (n - left - (ones - k)) / (n - left)
        gain[(v[1:] == v[:-1]) | (left < least) | (n - left < least)] = 0
        i = int(gain.argmax()) if n > 1 else 0
        if n > 1 and gain[i] > best[0] + 1e-12:
            best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
    return best


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 1, allowed: np.ndarray | None = None) -> Forest:
    """Trees on bootstrap samples in which either class has the same weight; each node draws the square root of the features.

    allowed (trees, rows) says which rows a tree may draw; both classes must be among them.
    """
    rng = np.random.default_rng(seed)
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    size, tried = max(1, len(y) // 2), max(1, round(np.sqrt(x.shape[1])))
    grown = []
    for t in range(trees):
        rows = np.concatenate([rng.choice(s if allowed is None else s[allowed[t, s]], size) for s in sides])
        nodes, todo = [[-1, 0.0, 0, 0.0]], [(0, rows, 0)]
        while todo:
            at, own, level = todo.pop()
            nodes[at][3] = float(y[own].mean())
            if level == depth or 0 == y[own].sum() or y[own].sum() == len(own):
                continue
            gain, f, t = _split(x[own], y[own], rng.choice(x.shape[1], tried, replace=False), least)
            if gain <= 0:
                continue
            nodes[at][:3] = [f, t, len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            high = x[own, f] > t
            todo += [(len(nodes) - 2, own[~high], level + 1), (len(nodes) - 1, own[high], level + 1)]
        grown.append(np.array(nodes))
    most = max(map(len, grown))
    full = np.stack([np.vstack([g, np.tile([-1, 0, 0, 0], (most - len(g), 1))]) for g in grown])
    return Forest(full[:, :, 0].astype(np.int64), full[:, :, 1], full[:, :, 2].astype(np.int64), full[:, :, 3])
