"""Gradient boosted trees for two classes, small enough to be trained on the driver and sent with a task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over binned features; deterministic. In features ``increasing`` the
    probability never falls: splits keep to the bounds of those above them.

    ``fit`` takes at most as many rows as the caller samples; ``predict`` gives calibrated probabilities. With rows of
    one class only, that class's rate (with a pseudo-row of each class) is predicted throughout.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0, increasing: tuple[int, ...] = ()):
        self.increasing = increasing
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.scale, self.shift = 0.0, 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.int16) if self.edges else np.zeros((len(x), 0), np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if len(y) == 0 or y.min() == y.max():
            return self
        held = np.arange(len(y)) % 5 == 0
        # bins of each class besides those of all: a rare value of one class isn't lumped with the other's
        at = np.linspace(0, 1, self.bins + 1)
        self.edges = [np.unique(np.r_[np.quantile(x[:, j], at[1:-1]), np.quantile(x[y > 0, j], at), np.quantile(x[y == 0, j], at)]) for j in range(x.shape[1])]
        b = self._binned(x)
        f = np.full(len(y), self.base)
        train = ~held
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = (y - q) * train, q * (1 - q) * train
            tree = self._grow(b, g, h)
            self.trees.append(tree)
            f += self._apply(tree, b)
        self.calibrate(f[held], y[held], np.ones(held.sum()))
        return self

    def start(self, edges: list[np.ndarray], p: float) -> None:
        """Begins without trees: ``edges`` are the features' bins, ``p`` the share of the class."""
        self.edges, self.base = edges, float(np.log(p / (1 - p)))

    def add_tree(self, x: np.ndarray, y: np.ndarray) -> None:
        """One more round, fitted to rows of its own with what the trees before say of them."""
        if len(y):
            b = self._binned(x)
            q = 1 / (1 + np.exp(-self._summed(b)))
            self.trees.append(self._grow(b, y - q, q * (1 - q)))

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        at = np.zeros(len(g), int)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for node in range(nodes):
            own = at == node
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = min(max(self.rate * gs / (hs + 1.0), low[node]), high[node])
            if node >= 2**self.depth - 1 or hs < self.least:
                continue
            best = 1e-6
            rows = b[own]
            for j in range(b.shape[1]):
                n = len(self.edges[j]) + 1
                gl, hl = np.cumsum(np.bincount(rows[:, j], g[own], n))[:-1], np.cumsum(np.bincount(rows[:, j], h[own], n))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < self.least / 4) | (hs - hl < self.least / 4)] = 0
                if j in self.increasing:
                    gain[gl / (hl + 1) > (gs - gl) / (hs - hl + 1)] = 0
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), j, int(gain.argmax())
            if feature[node] >= 0:
                low[[2 * node + 1, 2 * node + 2]], high[[2 * node + 1, 2 * node + 2]] = low[node], high[node]
                if feature[node] in self.increasing:
                    right = rows[:, feature[node]] > cut[node]
                    sides = [min(max(self.rate * g[own][m].sum() / (h[own][m].sum() + 1.0), low[node]), high[node]) for m in (~right, right)]
                    high[2 * node + 1] = low[2 * node + 2] = sum(sides) / 2
                at[own] = np.where(rows[:, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
        return feature, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            j = feature[at]
            go = j >= 0
            if not go.any():
                break
            right = b[np.flatnonzero(go), j[go]] > cut[at[go]]
            at[go] = 2 * at[go] + 1 + right
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The trees' log odds before they are calibrated."""
        return self._summed(self._binned(np.asarray(x, float)))

    def _summed(self, b: np.ndarray) -> np.ndarray:
        f = np.full(len(b), self.base)
        for tree in self.trees:
            f += self._apply(tree, b)
        return f

    def calibrate(self, f: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Logistic calibration on the rows held out of the training, each of them n times."""
        if n.sum() < 20 or y.min() == y.max():
            return
        a, c = 1.0, 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-(a * f + c)))
            w = n * (q * (1 - q) + 1e-6)
            ga, gc = (n * (y - q) * f).sum() - 0.1 * (a - 1), (n * (y - q)).sum() - 0.1 * c
            haa, hac, hcc = (w * f * f).sum() + 0.1, (w * f).sum(), w.sum() + 0.1
            det = haa * hcc - hac * hac
            a, c = a + (hcc * ga - hac * gc) / det, c + (haa * gc - hac * ga) / det
        if 0.05 < a < 20:
            self.scale, self.shift = float(a), float(c)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        return self.odds_to_p(self.raw(x))

    def odds_to_p(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * f + self.shift, -40, 40)))
