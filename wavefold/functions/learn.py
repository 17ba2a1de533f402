"""Learners of one cross-validation fold: boosted trees with their Shapley values, isotonic calibration, a stacker whose
weights lie on the simplex, and the few quantiles and metrics a fold needs. Folds are small and many, so each runs in
one task in NumPy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostParams:
    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.9
    gamma: float = 0.1
    ridge: float = 1.0
    least_weight: float = 1.0
    balance: bool = True
    seed: int = 0


#: Node arrays of a tree: feature (-1: a leaf), threshold (left if <=), left, right, whether missing goes left, value, cover.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


#: Values that a block of features has at most, so that what is made of them stays near the processor.
BLOCK = 30_000


@dataclass(frozen=True)
class _Block:
    """Features of one kind: whether some of their values are equal, or missing."""

    features: np.ndarray
    ties: bool
    missing: bool


class _Sorted:
    """Rows in the order of each feature (missing values last), in blocks of features of one kind; features without two
    different values can't be cut and are left out, but for the first, in whose order a node's rows are summed up."""

    def __init__(self, x: np.ndarray):
        n, d = x.shape
        order = np.argsort(np.ascontiguousarray(x.T), axis=1, kind="stable")
        v = np.take_along_axis(x.T, order, axis=1)
        have = ~np.isnan(v)
        up = (v[:, 1:] > v[:, :-1]) & have[:, 1:]
        some = up.any(axis=1) | (np.arange(d) == 0)
        missing = ~have.all(axis=1)
        ties = ~up.all(axis=1) & ~missing
        self.x, self.blocks, self.orders, self.first = x, [], [], (0, 0)
        if ties.any() or missing.any():
            self.have, self.ranks = ~np.isnan(x.T), np.zeros((d, n), np.int32)
            np.put_along_axis(self.ranks, order, np.concatenate([np.zeros((d, 1), np.int32), np.cumsum(up, axis=1, dtype=np.int32)], axis=1), axis=1)
        size = max(1, BLOCK // max(n, 1))
        for kind in ((t, m) for t in (False, True) for m in (False, True)):
            own = np.flatnonzero(some & (ties == kind[0]) & (missing == kind[1]))
            for k in range(0, len(own), size):
                if own[k] == 0:
                    self.first = len(self.blocks), 0
                self.blocks.append(_Block(own[k : k + size], *kind))
                self.orders.append(order[own[k : k + size]])


class Booster:
    """Second-order boosting of the logistic loss with exact splits and a learned side for missing values."""

    def __init__(self, params: BoostParams = BoostParams()):
        self.params, self.trees = params, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        p, r = self.params, np.random.default_rng(self.params.seed)
        y = np.asarray(y, float)
        pos = y.sum()
        w = np.where(y == 1, (len(y) - pos) / pos if p.balance and pos else 1.0, 1.0)
        z, sorted_ = np.zeros(len(y)), _Sorted(x)
        for _ in range(p.trees):
            q = 1 / (1 + np.exp(-z))
            use = r.random(len(y)) < p.subsample
            if not use.any():
                use[:] = True
            tree = self._grow(x, sorted_, w * (q - y), w * q * (1 - q), use)
            self.trees.append(tree)
            z += _walk(tree, x)
        return self

    def _grow(self, x: np.ndarray, sorted_: _Sorted, g: np.ndarray, h: np.ndarray, use: np.ndarray) -> Tree:
        p, nodes, gh = self.params, [], g + 1j * h

        def leaf(rows: np.ndarray) -> int:
            nodes.append([-1, 0.0, -1, -1, False, -p.rate * g[rows].sum() / (h[rows].sum() + p.ridge), h[rows].sum()])
            return len(nodes) - 1

        def build(rows: np.ndarray, depth: int, order: list[np.ndarray], keep: np.ndarray | None) -> int:
            """`order`: rows of the node above, of which `keep` are the node's, if it isn't all."""
            at = leaf(rows)
            if depth == p.depth or len(rows) < 2:
                return at
            order = [np.compress(np.take(keep, o).ravel(), o).reshape(len(o), len(rows)) for o in order] if keep is not None else order
            split = self._split(sorted_, order, gh)
            if split is None:
                return at
            f, t, left = split
            goes = np.where(np.isnan(x[rows, f]), left, x[rows, f] <= t)
            inside = np.zeros(len(g), bool)
            inside[rows[goes]] = True
            nodes[at][0], nodes[at][1], nodes[at][4] = f, t, left
            nodes[at][2] = build(rows[goes], depth + 1, order, inside)
            nodes[at][3] = build(rows[~goes], depth + 1, order, ~inside)
            return at

        build(np.flatnonzero(use), 0, sorted_.orders, None if use.all() else use)
        cols = list(zip(*nodes, strict=True))
        return tuple(np.array(c, t) for c, t in zip(cols, (int, float, int, int, bool, float, float), strict=True))

    def _split(self, sorted_: _Sorted, orders: list[np.ndarray], gh: np.ndarray) -> tuple[int, float, bool] | None:
        """The best cut of a node, whose rows `orders` hold in the order of each feature (missing values last), block by block:
        feature, threshold, whether missing values go left. A block's features, sides and places are scored at once; of
        equals the first."""
        p = self.params
        whole = gh[orders[sorted_.first[0]][sorted_.first[1]]]
        gs, hs = whole.real.sum(), whole.imag.sum()
        best = None
        with np.errstate(all="ignore"):
            for block, o in zip(sorted_.blocks, orders, strict=True):
                found = self._score(sorted_, block, o, np.take(gh, o), gs, hs)
                if found is not None and (best is None or found[0] > best[0] or (found[0] == best[0] and found[1] < best[1])):
                    best = found
        if best is None or (best[0] - gs * gs / (hs + p.ridge)) / 2 - p.gamma <= 1e-12:
            return None
        _, f, a, b, side = best
        return f, float((sorted_.x[a, f] + sorted_.x[b, f]) / 2), side

    def _score(self, sorted_: _Sorted, block: _Block, o: np.ndarray, gh: np.ndarray, gs: float, hs: float) -> tuple[float, int, int, int, bool] | None:
        """Score, feature, the rows on both sides of the cut and whether missing values go left, of a block's best cut."""
        p = self.params

        def scored(a: np.ndarray, c: np.ndarray, ok: np.ndarray | None) -> np.ndarray:
            d = hs - c
            heavy = (c >= p.least_weight) & (d >= p.least_weight)
            if ok is not None:
                heavy &= ok
            c = c + p.ridge
            d += p.ridge
            b = gs - a
            b *= b
            b /= d
            a = a * a
            a /= c
            a += b
            a[~heavy] = -np.inf
            return a

        if block.missing:
            have = np.take_along_axis(sorted_.have[block.features], o, axis=1)
            gh = np.where(have, gh, 0)
        run = np.cumsum(gh, axis=1)
        a, c = run.real[:, :-1], run.imag[:, :-1]
        ok = None
        if block.ties or block.missing:
            ranks = np.take_along_axis(sorted_.ranks[block.features], o, axis=1)
            ok = ranks[:, 1:] != ranks[:, :-1]
        if block.missing:
            ok &= have[:, 1:]
            gone = ~have.all(axis=1)[:, None]
            gm, hm = gs - run.real[:, -1:], hs - run.imag[:, -1:]
            # Axis 1: missing values to the left, to the right.
            score = np.stack([scored(a + gm, c + hm, ok & gone), scored(a, c, ok)], axis=1)
        else:
            score = scored(a, c, ok)[:, None]
        f, side, k = np.unravel_index(int(score.argmax()), score.shape)
        if score[f, side, k] == -np.inf:
            return None
        return float(score[f, side, k]), int(block.features[f]), int(o[f, k]), int(o[f, k + 1]), bool(block.missing and side == 0)

    def features(self) -> set[int]:
        """Those that some tree asks for."""
        return {int(f) for t in self.trees for f in t[0] if f >= 0}

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((_walk(t, x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def moved(self, x: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        """A function of a feature, rows of x and other values of the feature in these: what is predicted then. Only trees that
        ask for the feature are walked again."""
        known, asks, own = [_walk(t, x) for t in self.trees], [set(t[0].tolist()) for t in self.trees], x.copy()

        def predict(feature: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            own[rows, feature] = values
            z = sum((_walk(t, own) if feature in a else k for t, k, a in zip(self.trees, known, asks, strict=True)), np.zeros(len(x)))
            own[:, feature] = x[:, feature]
            return 1 / (1 + np.exp(-z[rows]))

        return predict

    def shap(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the margin by the path-dependent tree algorithm; a last column holds the expected margin."""
        out = np.zeros((len(x), x.shape[1] + 1))
        for t in self.trees:
            out[:, -1] += _expected(t)
            for i in range(len(x)):
                _tree_shap(t, x[i], out[i])
        return out


def _walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, missing, value, _ = tree
    at = np.zeros(len(x), int)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        n = at[rows]
        v = x[rows, feature[n]]
        at[rows] = np.where(np.where(np.isnan(v), missing[n], v <= cut[n]), left[n], right[n])
    return value[at]


def _expected(tree: Tree) -> float:
    feature, _, left, right, _, value, cover = tree

    def mean(n: int) -> float:
        if feature[n] < 0:
            return float(value[n])
        return float((cover[left[n]] * mean(left[n]) + cover[right[n]] * mean(right[n])) / cover[n]) if cover[n] else 0.0

    return mean(0)


def _tree_shap(tree: Tree, x: np.ndarray, out: np.ndarray) -> None:
    """The polynomial-time algorithm: a path keeps each feature's share of zeros and ones and the subset weights."""
    feature, cut, left, right, missing, value, cover = tree

    def extend(path: list[list[float]], zero: float, one: float, f: int) -> list[list[float]]:
        path = [p[:] for p in path] + [[f, zero, one, 1.0 if not path else 0.0]]
        n = len(path)
        for i in range(n - 2, -1, -1):
            path[i + 1][3] += one * path[i][3] * (i + 1) / n
            path[i][3] = zero * path[i][3] * (n - 1 - i) / n
        return path

    def unwind(path: list[list[float]], at: int) -> list[list[float]]:
        n, path = len(path), [p[:] for p in path]
        zero, one, rest = path[at][1], path[at][2], path[-1][3]
        for i in range(n - 2, -1, -1):
            if one:
                keep = path[i][3]
                path[i][3] = rest * n / ((i + 1) * one)
                rest = keep - path[i][3] * zero * (n - 1 - i) / n
            else:
                path[i][3] = path[i][3] * n / (zero * (n - 1 - i))
        for i in range(at, n - 1):
            path[i][:3] = path[i + 1][:3]
        return path[:-1]

    def visit(n: int, path: list[list[float]], zero: float, one: float, f: int) -> None:
        path = extend(path, zero, one, f)
        if feature[n] < 0:
            for k in range(1, len(path)):
                weight = sum(p[3] for p in unwind(path, k))
                out[int(path[k][0])] += weight * (path[k][2] - path[k][1]) * value[n]
            return
        v = x[feature[n]]
        hot = left[n] if (missing[n] if math.isnan(v) else v <= cut[n]) else right[n]
        cold = right[n] if hot == left[n] else left[n]
        zero, one = 1.0, 1.0
        for k in range(1, len(path)):
            if path[k][0] == feature[n]:
                zero, one = path[k][1], path[k][2]
                path = unwind(path, k)
                break
        whole = cover[n] or 1.0
        visit(hot, path, zero * cover[hot] / whole, one, int(feature[n]))
        visit(cold, path, zero * cover[cold] / whole, 0.0, int(feature[n]))

    visit(0, [], 1.0, 1.0, -1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators)."""
    keys, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, y) / weight
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return keys, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibrate(knots: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Linear between knots, constant outside."""
    return np.interp(x, *knots)


def logit(p: np.ndarray, edge: float = 0.001) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


def simplex_stacker(z: np.ndarray, y: np.ndarray, alpha: float = 1.05, steps: int = 2500, tol: float = 1e-9) -> np.ndarray:
    """Weights w >= 0 that sum to 1 and minimise the log-loss of sigmoid(z w) with a Dirichlet prior; by exponentiated
    gradient with step halving. Raises RuntimeError if it doesn't settle."""
    d = z.shape[1]
    w = np.full(d, 1 / d)
    sign = np.where(y == 1, 1.0, -1.0)
    loss = lambda w: float(np.logaddexp(0, -sign * (z @ w)).sum() - (alpha - 1) * np.log(w + 1e-12).sum())
    now, step = loss(w), 1.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(np.clip(sign * (z @ w), -500, 500)))
        grad = -(z.T @ (sign * q)) - (alpha - 1) / (w + 1e-12)
        grad -= grad @ w
        while True:
            move = np.exp(np.clip(-step * grad, -50, 50))
            new = w * move / (w * move).sum()
            then = loss(new)
            if then <= now or step < 1e-14:
                break
            step /= 2
        if now - then < tol * (1 + abs(now)):
            return new if then <= now else w
        w, now, step = new, then, step * 2
    raise RuntimeError("the stacker did not converge")


def optimal_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """The score with the largest sqrt(TPR * (1 - FPR)), the highest of equals."""
    cuts = np.unique(p)[::-1]
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    g = [math.sqrt(((p >= c) & (y == 1)).sum() / pos * (1 - ((p >= c) & (y == 0)).sum() / neg)) for c in cuts]
    return float(cuts[int(np.argmax(g))])


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: int) -> float:
    """By bisection on the regularised incomplete beta function's continued fraction."""
    if not 0.5 < p < 1 or df < 1:
        raise ValueError("0.5 < p < 1 and df >= 1")
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - 0.5 * _beta(df / 2, 0.5, df / (df + mid * mid)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out
