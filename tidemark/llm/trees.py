"""Small histogram trees for gradient boosting, grown in numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes as flat arrays; a leaf has feature -1.  A row goes left where its value is <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int32)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.threshold[node], self.left[node], self.right[node])


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature the ascending candidate thresholds: midpoints between neighbouring distinct quantiles."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="lower"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(codes, cuts, grad, hess, rows, depth, ridge=1.0, least=10, monotone=None) -> Tree:
    """A Newton tree on binned codes.  monotone[j] is 1, -1 or 0: how the value may move with feature j.

    A constrained split must order its children's values, and both subtrees stay on their side of the
    children's midpoint, so the whole tree is monotone.
    """
    nodes: list[list[float]] = []
    monotone = monotone or [0] * codes.shape[1]

    def best(rows, low, high):
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        top = (1e-6, -1, 0)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            c = codes[rows, j]
            size = len(cut) + 1
            gl = np.cumsum(np.bincount(c, g, size))[:-1]
            hl = np.cumsum(np.bincount(c, h, size))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=size))[:-1]
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            bad = (nl < least) | (len(rows) - nl < least)
            if monotone[j]:
                bad |= monotone[j] * (vr - vl) < 0
            gain = np.where(bad, -np.inf, gain)
            k = int(np.argmax(gain))
            if gain[k] > top[0]:
                top = (float(gain[k]), j, k)
        return top

    def build(rows, level, low, high) -> int:
        at = len(nodes)
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + ridge), low, high))
        nodes.append([-1, 0.0, -1, -1, value])
        if level == depth or len(rows) < 2 * least:
            return at
        gain, j, k = best(rows, low, high)
        if j < 0:
            return at
        side = codes[rows, j] <= k
        a, b = rows[side], rows[~side]
        la, ha, lb, hb = low, high, low, high
        if monotone[j]:
            va = np.clip(-grad[a].sum() / (hess[a].sum() + ridge), low, high)
            vb = np.clip(-grad[b].sum() / (hess[b].sum() + ridge), low, high)
            mid = (va + vb) / 2
            la, ha, lb, hb = (low, mid, mid, high) if monotone[j] > 0 else (mid, high, low, mid)
        left = build(a, level + 1, la, ha)
        right = build(b, level + 1, lb, hb)
        nodes[at][:4] = [j, float(cuts[j][k]), left, right]
        return at

    build(rows, 0, -np.inf, np.inf)
    f, t, le, r, v = zip(*nodes)
    return Tree(np.array(f, np.int32), np.array(t), np.array(le, np.int32), np.array(r, np.int32), np.array(v))


def boost(x, y, trees, depth, rate, bins=32, share=1.0, monotone=None, seed=7) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting: the log odds' start and trees whose values include the rate.

    With no rows the start is 0 (a score of one half); the prior is smoothed by one row of each class.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2) if n else 0.5
    start, out = float(np.log(prior / (1 - prior))), []
    if n < 20 or y.min() == y.max():
        return start, out
    cuts = cut_points(x, bins)
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rng, z = np.random.default_rng(seed), np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.arange(n) if share >= 1 else np.sort(rng.choice(n, max(20, int(share * n)), replace=False))
        tree = grow(codes, cuts, p - y, p * (1 - p), rows, depth, monotone=monotone)
        tree.value = tree.value * rate
        if len(tree.feature) > 1:
            out.append(tree)
        z = z + tree.predict(x)
    return start, out
