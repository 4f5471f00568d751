"""Gradient boosting of several classes over binned features, with stratified folds.

Features are cut at quantiles of all rows, so a row is a cell of a grid, and rows per cell, class and fold
are all that boosting needs of the data: Spark adds them up in one pass, and a grid has a stated number of cells at
most, however many rows there are.  Trees are grown on those sums, one for each class and stage.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.predict import confusion, folds

TREES, DEPTH, RATE, BINS = 80, 3, 0.08, 16
#: Cells that a grid may have.
CELLS = 1 << 18


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Quantiles of each feature over all rows, each value once; a value belongs above the cuts that it exceeds."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features)).first()
    return {f: sorted(set(found[f] or ())) for f in features}


def in_cells(rows: DataFrame, cuts: dict[str, list[float]], category: str | None, categories: Sequence[str]) -> DataFrame:
    """Adds ``_cell``: the numbers of cuts that each feature exceeds (none, if it is null), then the place of the category, the last for any other."""
    places = [sum(((F.coalesce(F.col(f), F.lit(float("-inf"))) > c).cast("int") for c in points), F.lit(0)) for f, points in cuts.items()]
    if category:
        known = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
        places.append(F.when(F.coalesce(F.array_position(known, F.col(category)), F.lit(0)) > 0, F.array_position(known, F.col(category)) - 1).otherwise(len(categories)).cast("int"))
    return rows.withColumn("_cell", F.array(*places))


class Boosted:
    """Scores of every cell it was fitted on or asked for; classes are numbered from 0."""

    def __init__(self, prior: np.ndarray):
        self.prior, self.stages = prior, []

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.prior, (len(x), 1))
        for trees in self.stages:
            for k, tree in enumerate(trees):
                out[:, k] += RATE * value(tree, x)
        return out


def value(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Leaf values of rows; a tree is (leaf value,) or (feature, greatest place on the left, left, right)."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = value(tree[2], x[left]), value(tree[3], x[~left])
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def grow(x: np.ndarray, n: np.ndarray, residual: np.ndarray, curve: np.ndarray, classes: int, depth: int) -> tuple:
    """A regression tree over cells: ``n`` rows each, with sums of residuals and of p (1 - p).

    A node is split where the squares' sum falls most, of equal splits at the first feature and place; leaves are Newton steps.
    """
    below = float(curve.sum())
    leaf = ((classes - 1) / classes * float(residual.sum()) / below if below > 1e-150 else 0.0,)
    if depth == 0 or n.sum() < 2:
        return leaf
    best = (1e-12 * max(1.0, float(np.abs(residual).sum())), None, None)
    for f in range(x.shape[1]):
        rows = np.cumsum(np.bincount(x[:, f], n))
        total = np.cumsum(np.bincount(x[:, f], residual))
        left, right = rows[:-1], rows[-1] - rows[:-1]
        fit = np.flatnonzero((left > 0) & (right > 0))
        if len(fit):
            means = total[:-1][fit] / left[fit] - (total[-1] - total[:-1][fit]) / right[fit]
            gain = left[fit] * right[fit] / rows[-1] * means**2
            at = int(gain.argmax())
            if gain[at] > best[0] * (1 + 1e-9):
                best = (float(gain[at]), f, int(fit[at]))
    if best[1] is None:
        return leaf
    side = x[:, best[1]] <= best[2]
    return (best[1], best[2], *(grow(x[s], n[s], residual[s], curve[s], classes, depth - 1) for s in (side, ~side)))


def fit(x: np.ndarray, counts: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Softmax boosting of cells (rows of places) with their rows by class."""
    n, classes = counts.sum(axis=1), counts.shape[1]
    model = Boosted(np.log(np.maximum(counts.sum(axis=0) / max(1.0, n.sum()), 1e-12)))
    scores = model.scores(x)
    for _ in range(trees):
        p = softmax(scores)
        stage = [grow(x, n, counts[:, k] - n * p[:, k], n * p[:, k] * (1 - p[:, k]), classes, depth) for k in range(classes)]
        for k, tree in enumerate(stage):
            scores[:, k] += RATE * value(tree, x)
        model.stages.append(stage)
    return model


def spread(cells: np.ndarray, categories: int | None) -> np.ndarray:
    """Places with the last one, a category's, as one column for each category."""
    if categories is None:
        return cells
    return np.hstack([cells[:, :-1], (cells[:, -1:] == np.arange(categories + 1)).astype(np.int64)])


def cross_validated(rows: DataFrame, features: Sequence[str], label: str, key: str, classes: Sequence[str], category: str | None = None, categories: Sequence[str] = (), n: int = 5, trees: int = TREES, bins: int = BINS) -> DataFrame:
    """(key, label, predicted): each row's class as told by the rows of other folds.

    Folds are stratified: at most ``n``, and no more than the rarest class has rows; with fewer than two the rows tell
    their own classes.  Rows of other classes than ``classes`` take no part; an empty table gives no rows.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)
    picked = rows.where(F.col(label).isin(*classes)).select(key, label, *features, *([category] if category else []))
    by_class = {r[0]: r[1] for r in picked.groupBy(label).count().collect()}
    parts = min(n, min((by_class.get(c, 0) for c in classes), default=0))
    dealt = in_cells(folds(picked, label, key, max(parts, 1)), cut_points(picked, features, bins), category, categories).select(key, label, "fold", "_cell")
    sums = dealt.groupBy("_cell", "fold", label).agg(F.count("*").alias("n"))
    grid = sums.select("_cell").distinct().limit(CELLS + 1).count()
    if grid > CELLS:
        raise ValueError(f"a grid of more than {CELLS} cells: use fewer bins or features")
    told = sums.collect()  # of at most CELLS cells, by class and fold
    cells = sorted({tuple(r["_cell"]) for r in told})
    if not cells:
        return spark.createDataFrame([], f"{key} {kind[key]}, label {kind[label]}, predicted string")
    at = {c: i for i, c in enumerate(cells)}
    x = spread(np.array(cells, np.int64), len(categories) if category else None)
    counts = np.zeros((max(parts, 1), len(cells), len(classes)))
    for r in told:
        counts[r["fold"], at[tuple(r["_cell"])], list(classes).index(r[label])] += r["n"]
    found = []
    for k in range(max(parts, 1)):
        train = counts.sum(axis=0) - (counts[k] if parts > 1 else 0)
        there = train.sum(axis=1) > 0
        scores = fit(x[there], train[there], trees).scores(x)
        found += [(list(c), k, classes[int(s.argmax())]) for c, s, m in zip(cells, scores, counts[k].sum(axis=1), strict=True) if m]
    named = spark.createDataFrame(found, "_cell array<int>, fold int, predicted string")
    return dealt.join(named, ["_cell", "fold"]).select(key, F.col(label).alias("label"), "predicted")


def accuracy(told: DataFrame) -> DataFrame:
    """(label, predicted, n, accuracy): the confusion of rows, and the share told rightly in all."""
    table = confusion(told)
    whole = table.agg(F.round(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return table.crossJoin(F.broadcast(whole))  # one row
