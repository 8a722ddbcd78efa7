"""A small random forest: grown on the driver from a bounded table, applied as a DataFrame expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, leaf: int = 3, seed: int = 11) -> list[Tree]:
    """Trees on bootstrap samples; each split tries a random square root of the features for the best Gini gain."""
    rng = np.random.default_rng(seed)
    tries = max(1, round(x.shape[1] ** 0.5) + 1)

    def grow(rows: np.ndarray, left: int) -> Tree:
        share = float(y[rows].mean())
        if not left or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return share
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
            gain = share * (1 - share) - (n * a * (1 - a) + (len(order) - n) * b * (1 - b)) / len(order)
            gain[(v[1:] == v[:-1]) | (n < leaf) | (len(order) - n < leaf)] = 0
            if len(gain) and gain.max() > best[0] + 1e-12:
                i = int(gain.argmax())
                best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        _, f, cut = best
        if f < 0:
            return share
        low = x[rows, f] <= cut
        return (f, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_score(forest: Sequence[Tree], feature: Callable[[int], Column]) -> Column:
    """The mean of the trees' leaves, between 0 and 1."""

    def walk(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, low, high = tree
        return F.when(feature(f) <= F.lit(cut), walk(low)).otherwise(walk(high))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / F.lit(float(len(forest)))
