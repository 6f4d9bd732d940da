"""Boosted trees on binned features: fitted on the driver from a table of bounded size, applied as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf (``feature`` below 0) or a split: values up to ``cut`` go to ``low``."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


@dataclass(frozen=True)
class Trees:
    """Log-odds: ``base`` plus the sum of the trees."""

    base: float
    trees: list[Node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _walk(t, x)
        return out

    def column(self, features: list[Column]) -> Column:
        """The log-odds as one expression."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + _column(t, features)
        return out


def _walk(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _walk(node.low, x), _walk(node.high, x))


def _column(node: Node, features: list[Column]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(features[node.feature] <= node.cut, _column(node.low, features)).otherwise(_column(node.high, features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float) -> Node:
    total_g, total_h = g.sum(), h.sum()
    leaf = Node(rate * total_g / (total_h + l2))
    if depth == 0 or len(x) < 2:
        return leaf
    best = (1e-6, -1, 0)
    for f in range(x.shape[1]):
        bins = int(x[:, f].max()) + 1
        left_g, left_h = (np.cumsum(np.bincount(x[:, f], v, bins))[:-1] for v in (g, h))
        if len(left_g):
            gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), f, k))
    _, f, cut = best
    if f < 0:
        return leaf
    low = x[:, f] <= cut
    return Node(0.0, f, cut, *(_grow(x[s], g[s], h[s], depth - 1, rate, l2) for s in (low, ~low)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; ``x`` holds bin numbers from 0, ``y`` 0 or 1, ``w`` weights."""
    if not len(x) or not w.sum():
        return Trees(0.0, [])
    share = min(max(float((w * y).sum() / w.sum()), 1e-6), 1 - 1e-6)
    base, trees = math.log(share / (1 - share)), []
    margin = np.full(len(x), base)
    for _ in range(rounds if 1e-6 < share < 1 - 1e-6 else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, w * (y - p), w * p * (1 - p), depth, rate, l2)
        trees.append(tree)
        margin += _walk(tree, x)
    return Trees(base, trees)
