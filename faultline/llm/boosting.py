"""Gradient-boosted trees with histograms, and isotonic calibration, in numpy.  For bounded samples on the driver."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted regression trees for the log-odds of a 0/1 target."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.base, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n = len(y)
        p = (y.sum() + 0.5) / (n + 1.0)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        # quantiles of the non-zero values too: rare features are mostly zero
        self.edges = [np.unique(np.concatenate([np.quantile(v, qs), np.quantile(v[v != 0], qs) if (v != 0).any() else [], [0.0]])) if n else np.zeros(1) for v in x.T]
        b, f = self._binned(x), np.full(n, self.base)
        width = max(len(e) for e in self.edges) + 1 if self.edges else 1
        for _ in range(self.rounds if n and 0 < y.sum() < n else 0):
            s = 1 / (1 + np.exp(-f))
            g, h = y - s, s * (1 - s)
            size = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            node, total_g, total_h = np.zeros(n, np.int64), {0: g.sum()}, {0: h.sum()}
            for level in range(self.depth + 1):
                first, many = (1 << level) - 1, 1 << level
                for k in range(first, first + many):
                    if k in total_g:
                        value[k] = total_g[k] / (total_h[k] + self.l2)
                if level == self.depth:
                    break
                live = node >= first
                at, gain = (node[live] - first) * width, {}
                for j in range(x.shape[1]):
                    key = at + b[live, j]
                    hg = np.bincount(key, g[live], many * width).reshape(many, width).cumsum(1)
                    hh = np.bincount(key, h[live], many * width).reshape(many, width).cumsum(1)
                    for k in range(many):
                        if first + k not in total_g:
                            continue
                        tg, th = total_g[first + k], total_h[first + k]
                        rg, rh = tg - hg[k], th - hh[k]
                        ok = (hh[k] > self.least * 0.05) & (rh > self.least * 0.05)
                        score = np.where(ok, hg[k] ** 2 / (hh[k] + self.l2) + rg**2 / (rh + self.l2) - tg**2 / (th + self.l2), 0)
                        c = int(score.argmax())
                        if score[c] > max(1e-6, gain.get(k, (0.0,))[0]):
                            gain[k] = (score[c], j, c, hg[k][c], hh[k][c])
                if not gain:
                    break
                for k, (_, j, c, lg, lh) in gain.items():
                    i = first + k
                    feature[i], cut[i] = j, c
                    total_g[2 * i + 1], total_h[2 * i + 1] = lg, lh
                    total_g[2 * i + 2], total_h[2 * i + 2] = total_g[i] - lg, total_h[i] - lh
                split = live & (feature[node] >= 0)
                i = node[split]
                node[split] = 2 * i + 1 + (b[split, :][np.arange(len(i)), feature[i]] > cut[i])
            value *= self.rate
            self.trees.append((feature, cut, value))
            f = f + value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                node = np.where(j >= 0, 2 * node + 1 + (b[np.arange(len(x)), np.maximum(j, 0)] > cut[node]), node)
            f = f + value[node]
        return f


class Isotonic:
    """Least-squares non-decreasing map of margins to rates (pool adjacent violators), linear between block means."""

    def fit(self, m: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(m, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, sum of m
        values, at = np.unique(m[order], return_index=True)
        for v, part in zip(values, np.split(y[order], at[1:])):
            blocks.append([float(part.sum()), float(len(part)), float(v) * len(part)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, w = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + w]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def __call__(self, m: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return 1 / (1 + np.exp(-m))
        return np.clip(np.interp(m, self.x, self.y), 0.0, 1.0)
