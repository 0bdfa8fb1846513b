"""A generalised additive model with pairwise interactions on binned features.

Every feature has a lookup table over its bins, and so has each of a few pairs of features. Shallow trees (two levels of
splits, at most four leaves) are boosted in cycles, one feature after the other, each adding its leaves times a small rate to
its own table; then the pairs with the most to gain from what is left are boosted the same way. A score is the sum of the
tables' cells, calibrated. Bags leave out one fold each, stop by it and are averaged cell by cell, as tables add up.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

from .word_quality import _platt

BINS, COARSE, RATE, RIDGE, LEAST = 32, 8, 0.06, 1.0, 4


def edges_of(x: np.ndarray) -> np.ndarray:
    """At most BINS - 1 cuts of a feature, at quantiles between its distinct values."""
    distinct = np.unique(x)
    if len(distinct) <= BINS:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def log_loss(m: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -m, m))))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins by sums of gradients, weights and rows; place 0 where none gains."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h, all_n = g.sum(), h.sum(), n.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_n < LEAST) | (all_n - left_n < LEAST)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + RIDGE))


def line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A two-level tree over one feature's bins, as a value for each bin."""
    out, cut = np.zeros(len(g)), best_cut(g, h, n)[1]
    for part in (slice(0, cut), slice(cut, len(g))) if cut else (slice(0, len(g)),):
        inner = best_cut(g[part], h[part], n[part])[1] if cut else 0
        middle = part.start + inner
        for piece in (slice(part.start, middle), slice(middle, part.stop)) if inner else (part,):
            out[piece] = leaf(g[piece], h[piece])
    return out


def grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A two-level tree over two features' bins: a cut along one, then in either part one along the other; the better order of the two."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b, c = (m.T if turned else m for m in (g, h, n))
        value, total = np.zeros_like(a), 0.0
        gain, cut = best_cut(a.sum(1), b.sum(1), c.sum(1))
        total += gain
        for part in (slice(0, cut), slice(cut, len(a))) if cut else (slice(0, len(a)),):
            gain, inner = best_cut(a[part].sum(0), b[part].sum(0), c[part].sum(0))
            total += gain
            for piece in (slice(0, inner), slice(inner, a.shape[1])) if inner else (slice(0, a.shape[1]),):
                value[part, piece] = leaf(a[part, piece], b[part, piece])
        if total > best:
            best, out = total, value.T if turned else value
    return out


def pair_gain(g: np.ndarray, h: np.ndarray) -> float:
    """What four leaves around the best corner of a coarse grid gain over none."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = (m[:-1, :-1] for m in (cg, ch))
    quarters = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quarters.append((cg[-1, -1] - a - quarters[1][0] - quarters[2][0], ch[-1, -1] - b - quarters[1][1] - quarters[2][1]))
    gain = sum(x**2 / (np.maximum(y, 0) + RIDGE) for x, y in quarters)
    return float(gain.max()) if gain.size else 0.0


@dataclass
class AdditiveModel:
    """Cuts and tables of the features, tables of the pairs, the bias and the two numbers of the calibration."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for (a, b), t in self.pairs.items():
            out += t[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(self.bins(x)) + self.offset)


def boost(bins: np.ndarray, y: np.ndarray, held: np.ndarray, start: np.ndarray, terms: list[tuple[int, ...]], sizes: list[int], cycles: int, patience: int) -> list[np.ndarray]:
    """Tables of ``terms`` (one feature or two), boosted in turn from the margins ``start``; those of the cycle with the least loss on ``held``."""
    shapes = [tuple(sizes[f] for f in t) for t in terms]
    cells = [np.ravel_multi_index([bins[:, f] for f in t], s) for t, s in zip(terms, shapes, strict=True)]
    tables = [np.zeros(s) for s in shapes]
    fit, m = ~held, start.copy()
    rows = [np.bincount(c[fit], minlength=int(np.prod(s))).reshape(s) for c, s in zip(cells, shapes, strict=True)]
    best, kept, since = log_loss(m[held], y[held]), [t.copy() for t in tables], 0
    for _ in range(cycles):
        for k, (c, s) in enumerate(zip(cells, shapes, strict=True)):
            p = sigmoid(m[fit])
            g, h = (np.bincount(c[fit], w, int(np.prod(s))).reshape(s) for w in (p - y[fit], p * (1 - p)))
            step = RATE * (line_tree if len(s) == 1 else grid_tree)(g, h, rows[k])
            tables[k] += step
            m += step.ravel()[c]
        loss = log_loss(m[held], y[held])
        if loss < best - 1e-6:
            best, kept, since = loss, [t.copy() for t in tables], 0
        elif (since := since + 1) >= patience:
            break
    return kept


def fit(x: np.ndarray, y: np.ndarray, n_pairs: int = 6, cycles: int = 150, patience: int = 8, bags: int = 4) -> AdditiveModel:
    """The model of rows x [n, features] and labels y (0/1, both kinds occur)."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [edges_of(x[:, f]) for f in range(x.shape[1])]
    sizes = [len(e) + 1 for e in edges]
    model = AdditiveModel(edges, [np.zeros(s) for s in sizes], float(np.log(share / (1 - share))))
    bins, fold = model.bins(x), np.arange(len(y)) % bags
    features = [(f,) for f in range(len(sizes)) if sizes[f] > 1]
    out_of_bag = np.full(len(y), model.bias)
    alone = []
    for b in range(bags):
        held = fold == b
        alone.append(boost(bins, y, held, np.full(len(y), model.bias), features, sizes, cycles, patience))
        for (f,), t in zip(features, alone[-1], strict=True):
            model.tables[f] += t / bags
            out_of_bag[held] += t[bins[held, f]]
    p = sigmoid(out_of_bag)
    coarse = {f: bins[:, f] * COARSE // sizes[f] for (f,) in features}
    gains = []
    for (a,), (b,) in combinations(features, 2):
        cell = coarse[a] * COARSE + coarse[b]
        gains.append((-pair_gain(*(np.bincount(cell, w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (p - y, p * (1 - p)))), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains)[:n_pairs]]
    model.pairs = {pair: np.zeros((sizes[pair[0]], sizes[pair[1]])) for pair in pairs}
    for b in range(bags if pairs else 0):
        held, start = fold == b, np.full(len(y), model.bias)
        for (f,), t in zip(features, alone[b], strict=True):
            start += t[bins[:, f]]
        for pair, t in zip(pairs, boost(bins, y, held, start, pairs, sizes, cycles, patience), strict=True):
            model.pairs[pair] += t / bags
            out_of_bag[held] += t[bins[held, pair[0]], bins[held, pair[1]]]
    model.slope, model.offset = _platt(out_of_bag, y)
    return model
