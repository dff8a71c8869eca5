"""Models of one series in numpy: seasonal trend, boosted trees, conditional variance."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Parameters of the boosted trees and of the seasonal trend.
DEPTH, RATE, ROW_SHARE, COLUMN_SHARE = 3, 0.01035, 0.802, 0.773
ROUNDS, SCORER_ROUNDS, FOLD_ROUNDS = 200, 100, 120
CHANGEPOINTS, CHANGE_RANGE, YEARLY, WEEKLY = 25, 0.8, 10, 3
CHANGE_SCALE = 0.05


@dataclass
class SeasonalTrend:
    """Piecewise linear trend with yearly and weekly Fourier terms, ridge-penalised.

    With laplace, a scale, the changes of slope have a Laplace prior instead (on the
    logarithm over its largest value, in time from 0 to 1), fitted by reweighting.
    """

    weekly: bool = True
    penalty: float = 1.0
    laplace: float | None = None
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _design(self, day: np.ndarray) -> np.ndarray:
        t = (day - self.start) / self.span
        cols = [np.ones(len(t)), t, *[np.maximum(0, t - k) for k in self.knots]]
        for period, order in ((365.25, YEARLY), (7.0, WEEKLY if self.weekly else 0)):
            for k in range(1, order + 1):
                cols += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
        return np.column_stack(cols)

    def fit(self, day: np.ndarray, y: np.ndarray) -> SeasonalTrend:
        self.start, self.span = float(day[0]), max(1.0, float(day[-1] - day[0]))
        n = min(CHANGEPOINTS, max(0, int(len(day) * CHANGE_RANGE) - 1))
        at = np.linspace(0, int(len(day) * CHANGE_RANGE) - 1, n + 1)[1:].round().astype(int) if n else np.zeros(0, int)
        self.knots = (day[at] - self.start) / self.span
        x = self._design(day)
        weight = np.full(x.shape[1], self.penalty)
        weight[:2] = 1e-8
        self.beta = np.linalg.solve(x.T @ x + np.diag(weight), x.T @ y)
        if self.laplace and n:
            changes, size = slice(2, 2 + n), float(np.abs(y).max()) or 1.0
            for _ in range(30):
                spread = max(float(np.square(y - x @ self.beta).mean()), 1e-12 * size**2)
                weight[changes] = spread / (self.laplace * size * (np.abs(self.beta[changes]) + 1e-6 * size))
                self.beta = np.linalg.solve(x.T @ x + np.diag(weight), x.T @ y)
        self.sigma = float(np.sqrt(np.square(y - x @ self.beta).mean()))
        return self

    def change(self) -> tuple[float, float]:
        """How often the slope changes a day, and the mean size of a change, per day."""
        deltas = np.abs(self.beta[2 : 2 + len(self.knots)])
        return (len(deltas) / self.span, float(deltas.mean()) / self.span) if len(deltas) else (0.0, 0.0)

    def predict(self, day: np.ndarray) -> np.ndarray:
        return self._design(np.asarray(day, float)) @ self.beta


def best_cuts(s: np.ndarray, c: np.ndarray, n: np.ndarray, total: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each node is split, at which column and after which bin; s, c: sums and counts of its rows (node, column, bin) up to the bin."""
    m, t = n[:, None, None], total[:, None, None]
    gain = np.where((c > 0) & (c < m), s**2 / (c + shrink) + (t - s) ** 2 / (m - c + shrink) - t**2 / (m + shrink), -1).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(len(n)), best] > 1e-12, best // s.shape[2], best % s.shape[2]


@dataclass
class BoostedTrees:
    """Squared-error trees on binned columns; rows and columns are sampled once a tree, leaves shrunk."""

    rounds: int = ROUNDS
    depth: int = DEPTH
    rate: float = RATE
    row_share: float = ROW_SHARE
    column_share: float = COLUMN_SHARE
    bins: int = 32
    shrink: float = 1.0
    seed: int = 42

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if x.shape[1] else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.base, self.trees = float(y.mean()), []
        b, guess = self._bin(x), np.full(len(y), y.mean())
        for _ in range(self.rounds if x.shape[1] else 0):
            rows = np.flatnonzero(rng.random(len(y)) < self.row_share)
            cols = np.sort(rng.choice(x.shape[1], max(1, int(self.column_share * x.shape[1])), replace=False))
            tree = self._grow(b, y - guess, rows, cols)
            self.trees.append(tree)
            guess += self.rate * self._leaves(tree, b)
        return self

    def _grow(self, b, g, rows, cols):
        """Arrays of split column, split bin and value of a full tree of `depth` levels, grown level by level."""
        inner, shrink = 2**self.depth - 1, self.shrink
        column, cut, value = np.full(inner, -1), np.zeros(inner, int), np.zeros(2 * inner + 1)
        width = max(2, *(len(self.edges[j]) + 1 for j in cols))
        x, y, at = b[np.ix_(rows, cols)], g[rows], np.zeros(len(rows), int)
        for level in range(self.depth + 1):
            nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            n, total = np.bincount(at, minlength=len(nodes)), np.bincount(at, y, minlength=len(nodes))
            value[nodes] = np.where(n > 0, total / (n + shrink), value[(nodes - 1) // 2])
            if level == self.depth:
                break
            shape = (len(nodes), len(cols), width)
            key = ((at[:, None] * len(cols) + np.arange(len(cols))) * width + x).ravel()
            s = np.bincount(key, np.repeat(y, len(cols)), minlength=np.prod(shape)).reshape(shape).cumsum(2)[:, :, :-1]
            c = np.bincount(key, minlength=np.prod(shape)).reshape(shape).cumsum(2)[:, :, :-1]
            good, j, k = best_cuts(s, c, n, total, shrink)
            column[nodes[good]], cut[nodes[good]] = cols[j[good]], k[good]
            on = good[at]
            x, y, at = x[on], y[on], at[on]
            at = 2 * at + (x[np.arange(len(at)), j[at]] > k[at])
        return column, cut, value

    @staticmethod
    def _leaves(tree, b):
        column, cut, value = tree
        node = np.zeros(len(b), int)
        for _ in range((len(value) + 1).bit_length() - 2):
            at = np.minimum(node, len(column) - 1)
            j = np.where(node < len(column), column[at], -1)
            right = b[np.arange(len(b)), np.maximum(j, 0)] > cut[at]
            node = np.where(j >= 0, 2 * node + 1 + right, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(np.asarray(x, float))
        return self.base + self.rate * sum((self._leaves(t, b) for t in self.trees), np.zeros(len(b)))


@dataclass
class Garch:
    """Zero-mean GARCH(1,1) by likelihood over a grid that narrows around its best point."""

    omega: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    last: float = 0.0

    @staticmethod
    def _likelihood(e2, omega, alpha, beta, start):
        s, total = np.full_like(alpha, start), np.zeros_like(alpha)
        for x in e2:
            total -= np.log(s) + x / s
            s = omega + alpha * x + beta * s
        return total, s

    def fit(self, e: np.ndarray) -> Garch:
        e2 = np.square(e)
        var = max(float(e2.mean()), 1e-12)
        centre, width = np.array([0.1, 0.8, 1.0]), np.array([0.1, 0.19, 0.7])
        for _ in range(4):
            steps = np.linspace(-1, 1, 7)
            a, b, k = (x.ravel() for x in np.meshgrid(*(c + w * steps for c, w in zip(centre, width))))
            ok = (a >= 0) & (b >= 0) & (a + b < 0.999) & (k > 0.05)
            a, b, k = a[ok], b[ok], k[ok]
            omega = k * var * (1 - a - b)
            fit, nxt = self._likelihood(e2, omega, a, b, var)
            i = int(fit.argmax())
            centre, width = np.array([a[i], b[i], k[i]]), width / 3
            self.omega, self.alpha, self.beta, self.last = float(omega[i]), float(a[i]), float(b[i]), float(nxt[i])
        return self

    def path(self, horizon: int) -> np.ndarray:
        long_run = self.omega / (1 - self.alpha - self.beta)
        return long_run + (self.alpha + self.beta) ** np.arange(horizon) * (self.last - long_run)
