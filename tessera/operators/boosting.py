"""Gradient-boosted regression trees and exact attributions of them, in numpy.

A model is fitted by one task on all its rows, as bins of two bytes, and the rows that it holds out go
down its trees with them.  Attributions are interventional Shapley values against a background: for
each leaf, rows and background are told apart only by which of its few features hold, so that counts
of patterns stand for pairs of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import factorial

import numpy as np


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 for a leaf), threshold, left and right child, NaN goes left?, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    nan_left: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            go = np.where(np.isnan(v), self.nan_left[at], v <= self.threshold[at])
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)

    def leaves(self) -> list[tuple[float, list[tuple[int, float, bool, bool]]]]:
        """(value, conditions) of each leaf; a condition is (feature, threshold, left, NaN goes here)."""
        out, todo = [], [(0, [])]
        while todo:
            n, path = todo.pop()
            if self.feature[n] < 0:
                out.append((float(self.value[n]), path))
                continue
            f, t, d = int(self.feature[n]), float(self.threshold[n]), bool(self.nan_left[n])
            todo += [(int(self.left[n]), [*path, (f, t, True, d)]), (int(self.right[n]), [*path, (f, t, False, not d)])]
        return out


@dataclass
class Forest:
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return self.base + sum((t.value[t.leaf_of(x)] for t in self.trees), np.zeros(len(x)))


def _bins(x: np.ndarray, bins: int, rows: np.ndarray | None = None, n: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The inner edges of each column's quantile bins, and each value's bin; missing values have one of their own.

    Of all rows or those given, in that order; the edges are those of the first n of them.
    """
    edges, binned = [], np.empty((x.shape[1], len(x) if rows is None else len(rows)), np.int16)
    for c, out in zip(x.T, binned):
        c = c if rows is None else c[rows]
        missing = np.isnan(c)
        known = c[:n][~missing[:n]]
        edges.append(np.unique(np.quantile(known, np.linspace(0, 1, bins + 1)[1:-1])) if len(known) else np.zeros(0))
        out[:] = np.where(missing, bins, np.searchsorted(edges[-1], c, "left"))
    return edges, binned.T


class Layout:
    """Binned columns as places in one histogram, in which a column has only the bins that it needs.

    ``place`` has each value's by column, counted from the column's ``first``; its last, ``gap``, is that of missing
    values.  A candidate is a split after the place ``at`` of the column ``of``, which begins at ``begin``.
    """

    def __init__(self, edges: list[np.ndarray], binned: np.ndarray, bins: int) -> None:
        self.edges = edges
        cuts = np.array([len(e) for e in edges])
        self.first = np.r_[0, np.cumsum(cuts + 2)]
        self.size = int(self.first[-1])
        self.gap = cuts + 1
        self.place = np.ascontiguousarray(binned.T, np.int16)  # the bins' own memory
        self.missing = np.zeros(len(edges), bool)
        for k, p in enumerate(self.place):
            none = p == bins
            self.missing[k] = none.any()
            p[none] = self.gap[k]
        self.of = np.repeat(np.arange(len(edges)), cuts)
        self.begin = self.first[self.of]
        self.at = self.begin + np.arange(len(self.of)) - np.r_[0, np.cumsum(cuts)][self.of]
        self.nan = self.first[self.of + 1] - 1

    def left(self, tree: Tree, inner: np.ndarray, span: slice) -> np.ndarray:
        """By inner node and row of the span: 1 where the row goes left."""
        f = tree.feature[inner]
        cut = np.array([np.searchsorted(self.edges[c], t) for c, t in zip(f, tree.threshold[inner])])
        values = self.place[f, span]
        left = values <= cut[:, None].astype(np.int16)
        for k in np.flatnonzero(tree.nan_left[inner]):
            left[k] |= values[k] == self.gap[f[k]]
        return left.view(np.uint8)


def _even(v: np.ndarray, times: int) -> np.ndarray:
    """The values on a grid so that sums of so many are exact, in whatever order and by differences too."""
    most = np.abs(v).max(initial=0.0) * times
    if not 0 < most < np.inf:
        return v
    unit = 2.0 ** (np.ceil(np.log2(most)) - 52)
    return np.rint(v / unit) * unit


#: Below so many rows the calls cost more than the counting.
FEW = 1500


def _grow(layout: Layout, g: np.ndarray, h: np.ndarray | None, use: np.ndarray, cols: np.ndarray, depth: int, rate: float, min_child: float, penalty: float) -> tuple[Tree, np.ndarray]:
    """One tree on gradients and hessians (None: all 1) of the rows ``use``, level by level, and each row's leaf.

    Only the smaller part of each split node is counted, the other is the difference.  Each column of many
    rows is counted alone, so that what is added to stays in the nearest cache; of few, all at once.
    """
    feature, threshold, left, right, nan_left, value = [-1], [0.0], [0], [0], [False], [0.0]
    cols = cols[[len(layout.edges[c]) > 0 for c in cols]]
    chosen = np.zeros(len(layout.edges), bool)
    chosen[cols] = True
    own = np.flatnonzero(chosen[layout.of])
    of, cut, begin, nans = layout.of[own], layout.at[own], layout.begin[own], layout.nan[own]
    gaps = np.flatnonzero(layout.missing[of])
    size, m, total = layout.size, len(cols), layout.place.shape[1]
    weights = [np.zeros(total), None if h is None else np.zeros(total)]
    weights[0][use] = _even(g[use], len(use) * (m + 1))
    if h is not None:
        weights[1][use] = _even(h[use], len(use) * (m + 1))
    used = np.zeros(total, bool)
    used[use] = True

    def summed(v: np.ndarray | None, of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of, None if v is None else v[rows], n).astype(float, copy=False)

    def counted(rows: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
        mine = [None if v is None else v[rows] for v in weights]
        if len(rows) < FEW:
            code = layout.place.take((cols * total)[:, None] + rows) + (layout.first[cols][:, None] + at * size)
            return [np.bincount(code.ravel(), None if v is None else np.tile(v, m), n * size).reshape(n, size).astype(float, copy=False) for v in mine]
        out, moved = [np.zeros((n, size)) for _ in weights], {}
        for c in cols.tolist():
            a, b = int(layout.first[c]), int(layout.first[c + 1])
            if b - a not in moved:
                moved[b - a] = at * (b - a)
            code = moved[b - a] + layout.place[c].take(rows)
            for o, v in zip(out, mine):
                o[:, a:b] = np.bincount(code, v, n * (b - a)).reshape(n, -1)
        return out

    leaf = np.zeros(total, np.int64)
    at, rows, level, hist = np.zeros(total, np.int64), np.arange(total), [0], None
    for d in range(depth + 1):
        n = len(level)
        mine = used[rows]
        own_at, own_rows = at[mine], rows[mine]
        gs, hs = (summed(v, own_at, own_rows, n) for v in weights)
        for node, v in zip(level, (rate * gs / (hs + penalty)).tolist()):
            value[node] = v
        if d == depth or not len(own):
            break
        if hist is None:
            hist = counted(own_rows, own_at, n)
        lg, lh = [], []
        for x, out in zip(hist, (lg, lh)):
            sums = np.cumsum(x, axis=1)
            out.append(sums.take(cut, axis=1))
            sums -= x
            out[0] -= sums.take(begin, axis=1)
        lg, lh = lg[0], lh[0]

        def best_of(lg: np.ndarray, lh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rh = hs[:, None] - lh
            gain = gs[:, None] - lg
            gain *= gain
            gain /= rh + penalty
            mine = lg * lg
            mine /= lh + penalty
            gain += mine
            np.copyto(gain, -np.inf, where=np.minimum(lh, rh, out=mine) < min_child)
            top = gain.argmax(axis=1)
            return top, gain[np.arange(n), top] - gs**2 / (hs + penalty)

        pick, best = best_of(lg, lh)
        nan = np.zeros(n, bool)
        if len(gaps):
            top, other = best_of(lg[:, gaps] + hist[0][:, nans[gaps]], lh[:, gaps] + hist[1][:, nans[gaps]])
            nan = other > np.maximum(best, 1e-9)
            pick[nan], best[nan] = gaps[top[nan]], other[nan]
        split = np.flatnonzero(best > 1e-9)
        if not len(split):
            break
        child = np.full(n, -1)
        below = []
        for k in split.tolist():
            node, c = level[k], int(of[pick[k]])
            feature[node], threshold[node], nan_left[node] = c, float(layout.edges[c][cut[pick[k]] - begin[pick[k]]]), bool(nan[k])
            left[node], right[node] = len(feature), len(feature) + 1
            child[k] = len(below)
            for part in (left[node], right[node]):
                below.append(part)
                feature.append(-1)
                threshold.append(0.0)
                left.append(0)
                right.append(0)
                nan_left.append(False)
                value.append(0.0)
        if len(split) < n:
            kept = child[at] >= 0
            rows, at = rows[kept], at[kept]
        column = of[pick]
        v = layout.place.ravel().take((column * total)[at] + rows)
        goes_right = v > (cut - begin)[pick].astype(np.int16)[at]
        if nan.any():
            goes_right &= ~((v == layout.gap[column].astype(np.int16)[at]) & nan[at])
        at, level = child[at] + goes_right, below
        leaf[rows] = np.array(below)[at]
        if d + 1 < depth:
            mine = used[rows]
            own_at, own_rows = at[mine], rows[mine]
            sizes = np.bincount(own_at, minlength=len(below)).reshape(-1, 2)
            small = sizes.argmin(axis=1)
            less = small[own_at >> 1] == (own_at & 1)
            mine = counted(own_rows[less], own_at[less] >> 1, len(split))
            pair = np.arange(len(split))
            for k, (x, y) in enumerate(zip(hist, mine)):
                both = np.empty((len(split), 2, size))
                both[pair, small], both[pair, 1 - small] = y, x[split] - y
                hist[k] = both.reshape(-1, size)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(nan_left), np.array(value)), leaf


def _drawn(rng, n: int, m: int, rows: float, columns: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    use = np.flatnonzero(rng.random(n) < rows) if rows < 1 else np.arange(n)
    cols = np.sort(rng.choice(m, max(1, int(m * columns)), replace=False))
    return (use if len(use) >= 2 * least else np.arange(n)), cols


def fit(x: np.ndarray, y: np.ndarray, **how) -> Forest:
    """Boosted trees on squared error by histograms; missing values take the better side of each split."""
    return fit_holding(x, y, np.arange(len(y)), np.zeros(0, np.int64), **how)[0]


def fit_holding(x: np.ndarray, y: np.ndarray, train: np.ndarray, held: np.ndarray, trees: int = 500, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, min_child: float = 5, penalty: float = 1.0, bins: int = 32, seed: int = 42) -> tuple[Forest, Layout | None, np.ndarray]:
    """The forest of the rows ``train`` in their order, and layout and predictions of them, then of those held out."""
    x, y = np.asarray(x, float), np.asarray(y, float)[train]
    rng = np.random.default_rng(seed)
    n, m = len(train), x.shape[1]
    base = float(y.mean()) if n else 0.0
    out: list[Tree] = []
    layout, pred = None, np.full(n + len(held), base)
    if n and m:
        layout = Layout(*_bins(x, bins, np.r_[train, held], n), bins)
        for _ in range(trees):
            use, cols = _drawn(rng, n, m, rows, columns, min_child)
            tree, leaf = _grow(layout, y - pred[:n], None, use, cols, depth, rate, min_child, penalty)
            out.append(tree)
            pred += tree.value[leaf]
    return Forest(base, out), layout, pred


def _weights(k: int) -> np.ndarray:
    """By pattern of x, pattern of the background row and feature: the share of a leaf's value."""
    w = np.zeros((1 << k, 1 << k, k))
    for p in range(1 << k):
        for q in range(1 << k):
            if (p | q) != (1 << k) - 1:
                continue  # a condition that neither fulfils
            mine, theirs = p & ~q, q & ~p
            a, b = mine.bit_count(), theirs.bit_count()
            for f in range(k):
                if mine >> f & 1:
                    w[p, q, f] = factorial(a - 1) * factorial(b) / factorial(a + b)
                elif theirs >> f & 1:
                    w[p, q, f] = -factorial(a) * factorial(b - 1) / factorial(a + b)
    return w


#: Rows that go through a tree's leaves at once.
BLOCK = 4096


def shapley(forest: Forest, x: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
    """(attributions by row and feature, expected value): they add up to the prediction."""
    x, background = np.asarray(x, float), np.asarray(background, float)
    rows = np.concatenate([background, x]).T

    def left(tree: Tree, inner: np.ndarray, span: slice) -> np.ndarray:
        values = rows[tree.feature[inner], span]
        return np.where(np.isnan(values), tree.nan_left[inner][:, None], values <= tree.threshold[inner][:, None]).view(np.uint8)

    phi = attributed(forest, left, len(background), len(rows.T), x.shape[1])
    return phi, float(forest.predict(background).mean()) if len(background) else forest.base


def attributed(forest: Forest, left: Callable[[Tree, np.ndarray, slice], np.ndarray], n: int, total: int, m: int) -> np.ndarray:
    """Attributions by row and feature of the rows from n on, against all the n before them as background.

    ``left`` tells for inner nodes and a span of rows who goes left.
    """
    phi = np.zeros((m, total - n))
    tables: dict[int, np.ndarray] = {}
    for tree in forest.trees:
        inner = np.flatnonzero(tree.feature >= 0)
        if not len(inner):
            continue
        place = np.zeros(len(tree.feature), np.int64)
        place[inner] = np.arange(len(inner))

        def leaves(span: slice, tree=tree, inner=inner, place=place) -> tuple[dict[int, list[tuple[float, tuple[int, ...]]]], dict[int, np.ndarray]]:
            """Values and paths of the leaves by number of features, and which of a path's features a row fails, as bits."""
            goes = left(tree, inner, span)
            # from a node to those below it
            todo, held, failed = [(0, (), np.zeros(goes.shape[1], np.uint8))], {}, {}
            while todo:
                node, path, fails = todo.pop()
                f = int(tree.feature[node])
                if f < 0:
                    if path and tree.value[node]:
                        held.setdefault(len(path), []).append((float(tree.value[node]), path))
                        failed.setdefault(len(path), []).append(fails)
                    continue
                below = path if f in path else (*path, f)
                if len(below) > 8 * fails.itemsize:
                    fails = fails.astype(np.uint32)
                bit = fails.dtype.type(1 << below.index(f))
                on = goes[place[node]] * bit
                todo += [(int(tree.left[node]), below, fails | (on ^ bit)), (int(tree.right[node]), below, fails | on)]
            return held, {k: np.stack(f) for k, f in failed.items()}

        counts: dict[int, np.ndarray] = {}
        for a in range(0, n, BLOCK):
            for k, theirs in leaves(slice(a, min(n, a + BLOCK)))[1].items():
                code = theirs + (np.arange(len(theirs)) << k)[:, None]
                c = np.bincount(code.ravel(), minlength=len(theirs) << k).reshape(len(theirs), -1)
                counts[k] = counts[k] + c if k in counts else c
        by_pattern: dict[int, np.ndarray] = {}
        for a in range(n, total, BLOCK):
            held, failed = leaves(slice(a, min(total, a + BLOCK)))
            for k, own in held.items():
                if k not in tables:  # by fulfilled bits of the background, of the row, and feature; turned to failed ones
                    tables[k] = np.ascontiguousarray(_weights(k)[::-1, ::-1].transpose(1, 2, 0)).reshape(1 << k, -1)
                if k not in by_pattern:
                    share = counts.get(k, np.zeros((len(own), 1 << k))) / max(1, n)
                    share *= np.array([v for v, _ in own])[:, None]
                    by_pattern[k] = (share @ tables[k]).reshape(len(own), k, 1 << k)
                for (_, path), f, table in zip(own, failed[k], by_pattern[k]):
                    phi[list(path), a - n : a - n + len(f)] += table.take(f, axis=1)
    return np.ascontiguousarray(phi.T)


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


LEVELS = (1, 2, 3, 4, 5)


def fit_ordinal(x: np.ndarray, y: np.ndarray, levels=LEVELS, **how) -> list[tuple[int, Forest]]:
    """A forest of margins by level, boosted together on the softmax of all; ``trees`` rounds of one tree a level."""
    return fit_ordinal_holding(x, y, np.arange(len(y)), np.zeros(0, np.int64), levels, **how)[0]


def fit_ordinal_holding(x: np.ndarray, y: np.ndarray, train: np.ndarray, held: np.ndarray, levels=LEVELS, trees: int = 500, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, min_child: float = 5, penalty: float = 1.0, bins: int = 32, seed: int = 42, keep: bool = True) -> tuple[list[tuple[int, Forest]], np.ndarray]:
    """The forests of the rows ``train`` in their order, unless they aren't to be kept, and the expected levels of those held out."""
    x, y = np.asarray(x, float), np.rint(np.asarray(y, float)[train])
    rng = np.random.default_rng(seed)
    n, m = len(train), x.shape[1]
    out: list[list[Tree]] = [[] for _ in levels]
    margins = np.zeros((n + len(held), len(levels)))
    if n and m:
        layout = Layout(*_bins(x, bins, np.r_[train, held], n), bins)
        is_level = (y[:, None] == np.array(levels)).astype(float)
        for _ in range(trees):
            p = _softmax(margins[:n])
            use, cols = _drawn(rng, n, m, rows, columns, min_child)
            for k in range(len(levels)):
                h = np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                tree, leaf = _grow(layout, is_level[:, k] - p[:, k], h, use, cols, depth, rate, min_child, penalty)
                margins[:, k] += tree.value[leaf]
                if keep:
                    out[k].append(tree)
    return [(k, Forest(0.0, f)) for k, f in zip(levels, out)], _softmax(margins[n:]) @ np.array(levels, float)


def expected_level(models: list[tuple[int, Forest]], x: np.ndarray) -> np.ndarray:
    """The expected level under the levels' probabilities."""
    p = _softmax(np.stack([f.predict(x) for _, f in models], axis=1))
    return p @ np.array([k for k, _ in models], float)
