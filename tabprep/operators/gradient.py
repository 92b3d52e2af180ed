"""Gradient boosting of trees for many runs side by side (L10, classification).

The library's learner runs a job for each level of each tree, again for each candidate and fold. Trees see a row only by the
bins of its features, so that rows of equal bins, class and fold are one cell with a count. Spark counts the cells; there are
as many as bins allow, however many rows. Each training (learning rate, depth, left-out fold) is then one row of Spark, all
side by side, over all cells; trainings of fewer trees are prefixes of the longest one. The trees are the library's: log loss,
the first tree on the classes as -1 and 1 with weight 1, the others on the residuals, splits of greatest variance gain, leaves
of means; three or more classes one against the rest.

More than CELLS cells are not for one task: ``search`` returns nothing, and the library's learner is trained instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vector, Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.boosting import BINS, thresholds

#: Cells that one training reads at most.
CELLS = 200_000


@dataclass
class Tree:
    """Nodes in order; a leaf has feature -1. A row goes left where its feature is at most the threshold."""

    feature: list[int] = field(default_factory=list)
    split: list[int] = field(default_factory=list)  # bins up to this one are left
    left: list[int] = field(default_factory=list)  # the right child is the next one
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)


def cut_points(rows: DataFrame, features: str) -> list[np.ndarray]:
    """Ends of the bins of each feature: between all values where there are at most BINS, else approximate quantiles."""
    quantiles = thresholds(rows, features)
    values = rows.select(F.posexplode(vector_to_array(features)).alias("f", "v")).where(~F.isnan("v")).distinct()
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("v"))).where(F.col("r") <= BINS + 1)
    own: list[list[float]] = [[] for _ in quantiles]
    for x in first.collect():  # BINS + 1 a feature
        own[x.f].append(x.v)
    return [np.unique(_between(np.sort(v))) if len(v) <= BINS else q for v, q in zip(own, quantiles, strict=True)]


def _between(values: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        middle = values[:-1] / 2 + values[1:] / 2
    return np.where(np.isfinite(middle) & (middle < values[1:]), middle, values[:-1])


def cells(rows: DataFrame, cuts: list[np.ndarray], features: str, label: str, fold: str) -> DataFrame:
    """(bins, label, fold, n): how many rows have equal bins of all features, class and fold. A missing value is in the last bin."""
    def place(ends: np.ndarray, x: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in ends]), lambda c: c < x)) if len(ends) else F.lit(0)

    some = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"), F.col(fold).cast("int").alias("fold"))
    return some.select(F.array(*[place(ends, F.col("x")[i]) for i, ends in enumerate(cuts)]).alias("bins"), "label", "fold").groupBy("bins", "label", "fold").agg(F.count(F.lit(1)).alias("n"))


def grow(bins: np.ndarray, target: np.ndarray, n: np.ndarray, width: int, depth: int) -> tuple[Tree, np.ndarray]:
    """A regression tree on cells of ``n`` rows each, level by level, and the value that it gives every cell. Cells of no
    rows are only scored."""
    tree, out = Tree(), np.zeros(len(n))
    sums, squares = n * target, n * target * target
    at, own, nodes = np.zeros(len(n), np.int64), np.arange(len(n)), [_leaf(tree)]
    for level in range(depth + 1):
        k = len(nodes)
        node_n, node_sum, node_sq = (np.bincount(at, w[own], k) for w in (n, sums, squares))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = node_sum / node_n
            plain = node_sum * mean
        gains, places = np.full((bins.shape[1], k), -np.inf), np.zeros((bins.shape[1], k), np.int64)
        for f in range(bins.shape[1] if level < depth else 0):
            key = at * width + bins[own, f]
            left_n, left_sum = (np.cumsum(np.bincount(key, w[own], k * width).reshape(k, width), axis=1)[:, :-1] for w in (n, sums))
            right_n, right_sum = node_n[:, None] - left_n, node_sum[:, None] - left_sum
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((left_n > 0) & (right_n > 0), left_sum**2 / left_n + right_sum**2 / right_n - plain[:, None], -np.inf)
            places[f] = gain.argmax(axis=1)
            gains[f] = np.take_along_axis(gain, places[f][:, None], axis=1)[:, 0]
        best = gains.argmax(axis=0)
        top = gains[best, np.arange(k)]
        split = top > 1e-12 * node_sq  # less is rounding
        children, first = [], np.full(k, -1, np.int64)
        for i, node in enumerate(nodes):
            tree.value[node] = float(mean[i])
            if split[i]:
                tree.feature[node], tree.split[node], tree.gain[node] = int(best[i]), int(places[best[i], i]), float(top[i])
                tree.left[node] = _leaf(tree)
                first[i] = len(children)
                children += [tree.left[node], _leaf(tree)]
        over = ~split[at]
        out[own[over]] = mean[at[over]]
        own, at = own[~over], at[~over]
        if not len(own):
            break
        right = bins[own, best[at]] > places[best[at], at]
        at, nodes = first[at] + right, children
    return tree, out


def _leaf(tree: Tree) -> int:
    for values, v in ((tree.feature, -1), (tree.split, -1), (tree.left, -1), (tree.value, 0.0), (tree.gain, 0.0)):
        values.append(v)
    return len(tree.value) - 1


def boost(bins: np.ndarray, truth: np.ndarray, n: np.ndarray, width: int, depth: int, rate: float, size: int):
    """For each of ``size`` rounds the tree, its weight and every cell's sum so far; ``truth``: 1 or -1."""
    total = np.zeros(len(n))
    for m in range(size):
        target = truth if m == 0 else 4 * truth / (1 + np.exp(np.minimum(2 * truth * total, 700)))
        tree, said = grow(bins, target, n, width, depth)
        weight = 1.0 if m == 0 else rate
        total = total + weight * said
        yield tree, weight, total


def _sides(label: np.ndarray, classes: list[float]) -> list[np.ndarray]:
    """1 and -1 for the second of two classes, or for each class against the rest."""
    return [np.where(label == c, 1.0, -1.0) for c in (classes if len(classes) > 2 else classes[-1:])]


def _decided(totals: np.ndarray, classes: list[float]) -> np.ndarray:
    """Class of each column of sums by class."""
    return np.array(classes)[totals.argmax(axis=0) if len(classes) > 2 else np.where(totals[0] > 0, len(classes) - 1, 0)]


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    rows = rows.assign(key=[tuple(b) for b in rows.bins]).sort_values(["key", "label", "fold"])  # sums don't depend on the order of arrival
    return np.array(rows.key.tolist(), np.int64).reshape(len(rows), -1), rows.label.to_numpy(float), rows.fold.to_numpy(), rows.n.to_numpy(float)


def _each_run(counted: DataFrame, runs: list[tuple], train, schema: str) -> DataFrame:
    """``train`` for every run (rate, depth, fold, sizes) over all cells, a run a task."""
    asked = counted.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, rate double, depth int, out int, sizes array<int>")
    return counted.crossJoin(F.broadcast(asked)).repartition(len(runs), "run").groupBy("run").applyInPandas(train, schema)


@dataclass
class Model:
    """The trees of each class (of the second, if there are two) with their weights."""

    classes: list[float]
    cuts: list[np.ndarray]
    trees: list[list[tuple[Tree, float]]]

    @property
    def featureImportances(self) -> Vector:  # noqa: N802 - as the library names it
        out = np.zeros(len(self.cuts))
        for t, _ in (t for own in self.trees for t in own):
            np.add.at(out, [f for f in t.feature if f >= 0], [g for f, g in zip(t.feature, t.gain, strict=True) if f >= 0])
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees for rows of features, by class."""
        bins = np.stack([np.where(np.isnan(x[:, f]), len(c), np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(self.cuts)], axis=1)
        out, rows = np.zeros((len(self.trees), len(x))), np.arange(len(x))
        for total, own in zip(out, self.trees, strict=True):
            for t, weight in own:
                feature, split, left, value = (np.array(v) for v in (t.feature, t.split, t.left, t.value))
                at = np.zeros(len(x), np.int64)
                while (inner := feature[at] >= 0).any():
                    at = np.where(inner, left[at] + (bins[rows, feature[at]] > split[at]), at)
                total += weight * value[at]
        return out

    def score(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with prediction and probability (null for three or more classes, as the library's learner has none)."""
        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(self.margins(np.stack(x.to_numpy()).astype(float)).T)) if len(x) else pd.Series([], dtype=object)

        out, found = df.withColumn("__margins", margins(vector_to_array(F.col(features)))), F.col("__margins")
        classes = F.array(*[F.lit(float(c)) for c in self.classes])
        if len(self.classes) > 2:
            at, chance = F.array_position(found, F.array_max(found)), F.lit(None).cast("array<double>")
        else:
            at, p = F.when(found[0] > 0, len(self.classes)).otherwise(1), 1 / (1 + F.exp(-2 * found[0]))
            chance = F.array(1 - p, p) if len(self.classes) == 2 else F.array(F.lit(1.0))
        return out.withColumn("prediction", F.element_at(classes, at.cast("int"))).withColumn("probability", chance).drop("__margins")


def search(rows: DataFrame, candidates: list[dict], folds: int, classes: list[float], features: str = "features", label: str = "label", fold: str = "fold") -> tuple[dict, Model] | None:
    """The candidate (maxIter, stepSize, maxDepth) of best mean accuracy over the folds, the first on ties, and its model on
    all rows; None if there are more than CELLS cells. Rows with a null label, fold or features take no part."""
    known = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull() & F.col(features).isNotNull())
    cuts = cut_points(known, features)
    counted = cells(known, cuts, features, label, fold).persist()
    try:
        if counted.limit(CELLS + 1).count() > CELLS:
            return None
        asked = [(float(c.get("stepSize", 0.1)), int(c.get("maxDepth", 3)), int(c.get("maxIter", 100))) for c in candidates]
        width = max((len(c) for c in cuts), default=0) + 1

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            bins, truth, folds_of, n = _opened(rows)
            own = folds_of == rows.out.iloc[0]
            sizes, train = sorted(rows.sizes.iloc[0]), np.where(own, 0.0, n)
            if not own.any() or not train.any():
                return pd.DataFrame({"rate": [], "depth": [], "size": [], "score": []})
            kept = {}
            for c, side in enumerate(_sides(truth, classes)):
                for m, (_, _, total) in enumerate(boost(bins, side, train, width, rows.depth.iloc[0], rows.rate.iloc[0], sizes[-1]), 1):
                    if m in sizes:
                        kept[m, c] = total[own]
            right = [float(n[own] @ (_decided(np.stack([kept[s, c] for c in range(len(kept) // len(sizes))]), classes) == truth[own])) / float(n[own].sum()) for s in sizes]
            return pd.DataFrame({"rate": rows.rate.iloc[0], "depth": rows.depth.iloc[0], "size": sizes, "score": right})

        best = 0
        if len(asked) > 1:
            runs = [(r, d, f, sorted({n for a, b, n in asked if (a, b) == (r, d)})) for r, d in sorted({a[:2] for a in asked}) for f in range(folds)]
            found = _each_run(counted, runs, scored, "rate double, depth int, size int, score double").groupBy("rate", "depth", "size").agg(F.sum("score").alias("s"))
            scores = {(x.rate, x.depth, x["size"]): x.s for x in found.collect()}
            best = max(range(len(asked)), key=lambda i: (scores.get(asked[i], 0.0), -i))
        rate, depth, size = asked[best]

        def trained(rows: pd.DataFrame) -> pd.DataFrame:
            bins, truth, _, n = _opened(rows)
            told = [(c, m, w, t.feature, t.split, t.left, t.value, t.gain) for c, side in enumerate(_sides(truth, classes))
                    for m, (t, w, _) in enumerate(boost(bins, side, n, width, depth, rate, size))]
            return pd.DataFrame(told, columns=["cls", "round", "weight", "feature", "split", "left", "value", "gain"])

        schema = "cls int, round int, weight double, feature array<int>, split array<int>, left array<int>, value array<double>, gain array<double>"
        trees: list[list[tuple[Tree, float]]] = [[] for _ in (classes if len(classes) > 2 else classes[-1:])]
        for x in _each_run(counted, [(rate, depth, None, [size])], trained, schema).orderBy("cls", "round").collect():
            trees[x.cls].append((Tree(x.feature, x.split, x.left, x.value, x.gain), x.weight))
        return candidates[best], Model(classes, cuts, trees)
    finally:
        counted.unpersist()
