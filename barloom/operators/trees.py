"""Small tree models of one training window, for the tasks of rolling_predictions: boosted, bagged and extremely randomised.

Features are cut into quantile bins, so a level of a tree is one histogram of all nodes, features and bins. The trees of a
round of boosting (one a class), and lots of a forest's, grow together: their nodes share the histogram. A tree is complete:
nodes that don't split send all rows left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import ModelSettings

#: Entries of a histogram's index that a lot of a forest may have.
CELLS = 1 << 20


@dataclass
class Trees:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each node (-1: no split), leaves' values by class
    boosted: bool
    seen: np.ndarray
    gain: np.ndarray

    def shares(self) -> np.ndarray:
        total = self.gain.sum()
        return self.gain / total if total > 0 else np.full(len(self.gain), 1 / len(self.gain))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.int64)


def leaves(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(int(np.log2(len(feature) + 1))):
        f = feature[node]
        node = 2 * node + 1 + ((f >= 0) & (codes[rows, f] > cut[node]))
    return node - len(feature)


def grow_many(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rng, allowed, ridge: float, loss: float, least: float, bins: int, random_cuts: bool = False):
    """Trees of second-order gains over the same rows, all grown at once.

    g, h: gradients and weights by tree, row and output (weights may have one for all outputs); allowed(nodes): features by
    tree and node; loss: gain that a split must exceed.
    """
    (many, n, outputs), wide = g.shape, codes.shape[1]
    size = 2**depth - 1
    feature, cut, gained = np.full((many, size), -1), np.zeros((many, size), np.int64), np.zeros((many, wide))
    node, rows, tree = np.zeros((many, n), np.int64), np.arange(n), np.arange(many)[:, None]
    cells = codes + np.arange(wide) * bins
    score = lambda a, b: (a * a / np.maximum(b + ridge, 1e-12)).sum(0)
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        shape = (many, nodes, wide, bins)
        at = (((tree * nodes + node - first) * (wide * bins))[:, :, None] + cells).ravel()
        tables = [np.stack([np.bincount(at, np.repeat(v[:, :, k].ravel(), wide), many * nodes * wide * bins).reshape(shape) for k in range(v.shape[2])]) for v in (g, h)]
        left, whole = [t.cumsum(-1) for t in tables], [t.sum(-1, keepdims=True) for t in tables]
        right = [w - x for w, x in zip(whole, left, strict=True)]
        gain = 0.5 * (score(*left) + score(*right) - score(*whole))
        gain[(left[1].sum(0) < least) | (right[1].sum(0) < least)] = -np.inf
        gain[~allowed(nodes)] = -np.inf
        if random_cuts:
            only = np.zeros(shape, bool)
            np.put_along_axis(only, rng.integers(0, bins - 1, shape[:3])[..., None], True, -1)
            gain = np.where(only, gain, -np.inf)
        flat = gain.reshape(many, nodes, -1)
        best = flat.argmax(2)
        top = np.take_along_axis(flat, best[..., None], 2)[..., 0]
        split = top > loss
        feature[:, first : first + nodes], cut[:, first : first + nodes] = np.where(split, best // bins, -1), best % bins
        np.add.at(gained, (np.broadcast_to(tree, split.shape)[split], (best // bins)[split]), top[split])
        f = feature[tree, node]
        node = 2 * node + 1 + ((f >= 0) & (codes[rows, f] > cut[tree, node]))
    leaf = (tree * 2**depth + node - size).ravel()
    total = [np.stack([np.bincount(leaf, v[:, :, k].ravel(), many * 2**depth).reshape(many, -1) for k in range(v.shape[2])], -1) for v in (g, h)]
    return feature, cut, -total[0] / np.maximum(total[1] + ridge, 1e-12), gained


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rng, allowed, ridge: float, loss: float, least: float, random_cuts: bool = False, bins: int | None = None):
    """One tree. g, h by row and output, allowed(nodes): features by node."""
    found = grow_many(codes, g[None], h[None], depth, rng, lambda nodes: allowed(nodes)[None], ridge, loss, least, bins or int(codes.max()) + 2, random_cuts)
    return tuple(x[0] for x in found)


def softmax(margin: np.ndarray, seen: np.ndarray) -> np.ndarray:
    p = np.exp(np.where(seen, margin, -np.inf) - margin[:, seen].max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """The quantiles of each column that part its bins."""
    return [np.unique(q) for q in np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, kind: str, s: ModelSettings = ModelSettings(), seed: int = 42) -> Trees:
    """kind: boosted (a tree for each class and round; the newest rows say when to stop), forest or extra. y: classes 0, 1, 2."""
    rng, (n, wide) = np.random.default_rng(seed), x.shape
    bins = max(2, min(s.boost_bins if kind == "boosted" else s.forest_bins, n))
    edges = cuts_of(x, bins)
    codes, seen, target = binned(x, edges), np.isin(np.arange(3), y), np.eye(3)[y]
    trees, gain = [], np.zeros(wide)
    if kind != "boosted":
        some, lot = max(1, round(wide**0.5)), max(1, CELLS // (n * wide))
        for done in range(0, s.trees, lot):
            many = min(lot, s.trees - done)
            w = np.stack([weight if kind == "extra" else weight * np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(many)])
            allowed = lambda nodes, many=many: (rng.random((many, nodes, wide)).argsort(2).argsort(2) < some)
            feature, cut, value, gained = grow_many(codes, -target * w[:, :, None], w[:, :, None], s.tree_depth, rng, lambda nodes, a=allowed: np.repeat(a(nodes)[..., None], bins, 3), 0.0, 1e-12, 1e-9, bins, kind == "extra")
            trees += list(zip(feature, cut, value, strict=True))
            gain += gained.sum(0)
        return Trees(edges, trees, False, seen, gain)
    held = int(n * s.early_share) if s.early_rounds > 0 else 0
    learn = n - held
    if held < 20 or not (np.isin(np.arange(3), y[:learn]) == seen).all():
        held, learn = 0, n
    margin, best, best_at, classes = np.zeros((n, 3)), np.inf, 0, np.flatnonzero(seen)
    for turn in range(s.boost_rounds):
        p = softmax(margin, seen)
        rows = np.flatnonzero(rng.random(learn) < s.boost_rows)
        chosen = np.zeros(wide, bool)
        chosen[rng.permutation(wide)[: max(1, round(wide * s.boost_columns))]] = True
        q, w = p[np.ix_(rows, classes)].T, weight[rows]
        g, h = (q - target[np.ix_(rows, classes)].T) * w, np.maximum(2 * q * (1 - q), 1e-16) * w
        feature, cut, value, gained = grow_many(codes[rows], g[..., None], h[..., None], s.boost_depth, rng, lambda nodes: np.broadcast_to(chosen[:, None], (len(classes), nodes, wide, bins)), s.boost_ridge, s.boost_gain, s.boost_least, bins)
        for i, k in enumerate(classes):
            step = np.zeros((value.shape[1], 3))
            step[:, k] = s.boost_rate * value[i, :, 0]
            margin += step[leaves(codes, feature[i], cut[i])]
            trees.append((feature[i], cut[i], step))
        gain += gained.sum(0)
        if held:
            loss = -np.log(np.maximum(softmax(margin[learn:], seen)[np.arange(held), y[learn:]], 1e-15)).mean()
            if loss < best:
                best, best_at = loss, turn
            elif turn - best_at >= s.early_rounds:
                break
    if held:
        trees = trees[: (best_at + 1) * len(classes)]
    return Trees(edges, trees, True, seen, gain)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probabilities of the three classes; 0 for one that training never saw."""
    codes = binned(x, model.edges)
    total = sum((value[leaves(codes, feature, cut)] for feature, cut, value in model.trees), np.zeros((len(x), 3)))
    if model.boosted:
        return softmax(total, model.seen)
    total = np.maximum(total, 0.0)
    return total / total.sum(1, keepdims=True)
