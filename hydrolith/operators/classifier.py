"""A forest of decision trees on gates, scored as column expressions.

Trees are grown on a bounded sample of labelled rows; scoring is nested conditions
inside the JVM, over all rows. Whole volumes are held out by a hash of their key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a forest is grown on at most: those of the least hashes.
SAMPLE = 20_000
#: Thresholds that a node tries for a feature.
CUTS = 24


@dataclass(frozen=True)
class Node:
    """A leaf has p alone; else rows with the feature at most ``cut`` go left, and
    nulls where most rows of the sample went."""

    p: float
    feature: int = -1
    cut: float = 0.0
    null_left: bool = True
    left: Node | None = None
    right: Node | None = None


def held_out(volume: list[str], share: int = 5, seed: int = 3) -> Column:
    """One volume in ``share``, whole; a null key is a volume."""
    return F.pmod(F.xxhash64(F.lit(seed), *volume), F.lit(share)) == 0


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Node:
    """A tree by the least Gini impurity over a root's worth of features a node."""
    p = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return Node(p)
    best = None
    for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))].tolist():
        v = x[:, f]
        known = ~np.isnan(v)
        if known.sum() < 2 * least:
            continue
        for cut in np.unique(np.quantile(v[known], np.linspace(0.02, 0.98, CUTS))).tolist():
            below = v <= cut
            null_left = bool(below.sum() * 2 >= known.sum())
            left = below | (~known & null_left)
            n = int(left.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut, null_left, left
    if best is None or best[0] >= len(y) * p * (1 - p) - 1e-9:
        return Node(p)
    _, f, cut, null_left, left = best
    return Node(p, f, cut, null_left, grow(x[left], y[left], rng, depth - 1, least), grow(x[~left], y[~left], rng, depth - 1, least))


def fit(rows: DataFrame, features: list[str], label: str, volume: list[str], trees: int = 12, depth: int = 6, least: int = 20, sample: int = SAMPLE, seed: int = 3) -> list[Node]:
    """Trees on resamples of at most ``sample`` labelled rows of volumes that are not
    held out. Rows without a label are left out; without any rows, or with one class,
    trees are leaves. The sample does not depend on how rows are dealt."""
    own = rows.filter(F.col(label).isNotNull() & ~held_out(volume)).select(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    order = F.xxhash64(F.lit(seed), *own.columns)
    taken = own.orderBy(order, *own.columns).limit(sample).toPandas()
    x, y = taken[[f"f{k}" for k in range(len(features))]].to_numpy(float), taken["y"].to_numpy(float)
    out = []
    for k in range(trees):
        rng = np.random.default_rng([seed, k])
        own_rows = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, np.int64)
        out.append(grow(x[own_rows], y[own_rows], rng, depth, least))
    return out


def expression(node: Node, features: list[str]) -> Column:
    """A tree as nested conditions."""
    if node.feature < 0:
        return F.lit(node.p)
    v = F.col(features[node.feature]).cast("double")
    v = F.when(~F.isnan(v), v)
    left = (v <= node.cut) | v.isNull() if node.null_left else F.coalesce(v <= node.cut, F.lit(False))
    return F.when(left, expression(node.left, features)).otherwise(expression(node.right, features))


def probability(forest: list[Node], features: list[str]) -> Column:
    """The mean of the trees'; 0.0 for an empty forest."""
    return reduce(lambda a, b: a + b, (expression(t, features) for t in forest), F.lit(0.0)) / max(1, len(forest))


def leaf_of(node: Node, row: list[float | None]) -> float:
    """The plain walk that ``expression`` compiles."""
    while node.feature >= 0:
        v = row[node.feature]
        node = node.left if (node.null_left if v is None or v != v else v <= node.cut) else node.right
    return node.p
